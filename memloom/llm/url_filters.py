"""URL filters: host and path rules, and pattern rules that are found by their rarest literal token.

The tokens that every match of a pattern must hold are derived from its parse tree. An index from tokens to patterns goes to
all tasks; a URL's own tokens fetch the few patterns that may match, and only those are run.
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as sre_parser
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm.common import ascii_lower, table

#: (host and path, verdict). The longest rule that fits decides.
HOST_RULES: tuple[tuple[str, str], ...] = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


@dataclass(frozen=True)
class Pattern:
    """regex: searched in the lower-cased URL, in syntax that both Python's re and SQL engines take."""

    regex: str
    verdict: str = "block"


#: Names that block a URL as a whole word of host, path or query.
BLOCKED_WORDS = ("casino", "adult", "poker", "betting", "escort", "porn", "xxx", "viagra", "payday", "warez", "torrent", "keygen")
#: Hosts whose first label names a service of advertising or counting.
BLOCKED_SERVICES = ("ads?", "adserver", "banners?", "pixel", "track(er|ing)?", "stats?", "click", "popunder", "telemetry", "beacon")
#: Paths that hold no text of their own.
BLOCKED_PATHS = ("cart", "checkout", "basket", "wishlist", "log-?in", "log-?out", "signin", "signup", "register", "password-reset", "print", "share", "feed", "rss", "tag", "calendar", "search", "compare")
#: Query parameters of sessions, campaigns and endless lists.
BLOCKED_QUERIES = ("session_?id=[0-9a-f]+", "phpsessid=[0-9a-z]+", "utm_source=feed(&|#|$)", "replytocom=[0-9]+", "sort=[a-z]+", "page=[0-9]{3,}(&|#|$)", "add-to-cart=[0-9]+", "fbclid=", "gclid=")
PATTERNS: tuple[Pattern, ...] = (
    Pattern(r"[./]example\.[a-z]+/robots\.txt$", "allow"),
    *(Pattern(rf"[^a-z0-9]{w}[^a-z0-9]") for w in BLOCKED_WORDS),
    *(Pattern(rf"://{s}\.") for s in BLOCKED_SERVICES),
    Pattern(r"://m\.[^/]*/[a-z]{2}/[0-9]+/?$", "allow"),
    *(Pattern(rf"/{p}/") for p in BLOCKED_PATHS),
    *(Pattern(rf"[?&]{q}") for q in BLOCKED_QUERIES),
    Pattern(r"/(wp-login|wp-admin|xmlrpc)\.php"),
    Pattern(r"/(wp-content|wp-includes|node_modules)/"),
    Pattern(r"\.(zip|exe|apk|iso|dmg)$"),
)
#: The most rules of either kind in one index: it is sent to all tasks, so its size is bounded. More rules make more indexes.
MOST_RULES = 10_000
#: Strings that a part of a pattern can stand for are spelled out up to so many.
SPELLED = 64

_TOKEN = re.compile("[a-z0-9]+")
_ALNUM = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
#: In spelled strings: here something may stand that the token goes on with, and here nothing of a token can stand.
_OPEN, _EDGE = "?", "-"
_CLASSES = {sre.CATEGORY_DIGIT: frozenset("0123456789"), sre.CATEGORY_WORD: _ALNUM, sre.CATEGORY_SPACE: frozenset()}


def _class_of(items: Sequence) -> frozenset[str]:
    """The letters and digits (folded) that a character class can stand for."""
    out: set[str] = set()
    negated = False
    for op, arg in items:
        if op is sre.NEGATE:
            negated = True
        elif op is sre.LITERAL:
            out.add(chr(arg))
        elif op is sre.RANGE:
            out |= {c for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "".join(_ALNUM) if arg[0] <= ord(c) <= arg[1]}
        elif op is sre.CATEGORY and arg in _CLASSES:
            out |= _CLASSES[arg]
        else:
            return _ALNUM
    return _ALNUM - out if negated else frozenset(c.lower() for c in out) & _ALNUM


def _spelled(op, arg) -> set[str]:
    """What an item of the parse tree stands for: strings of folded literals, _EDGE for what is no letter or digit, _OPEN for the rest."""
    if op is sre.LITERAL:
        c = chr(arg).lower() if arg < 128 else _EDGE
        return {c if c in _ALNUM else _EDGE}
    if op is sre.IN:
        letters = _class_of(arg)
        if all(o is sre.LITERAL for o, _ in arg):
            return set(letters) | ({_EDGE} if any(chr(a).lower() not in _ALNUM for _, a in arg) else set())
        return {_OPEN} if letters else {_EDGE}
    if op is sre.AT:
        return {_EDGE} if arg in (sre.AT_BEGINNING, sre.AT_BEGINNING_STRING, sre.AT_END, sre.AT_END_STRING) else {_OPEN}
    if op is sre.SUBPATTERN:
        return _spelled_all(arg[3])
    if op is sre.BRANCH:
        out = set().union(*map(_spelled_all, arg[1]))
        return out if len(out) <= SPELLED else {_OPEN}
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, one = arg[0], arg[1], _spelled_all(arg[2])
        if high <= 4 and sum(len(one) ** n for n in range(low, high + 1)) <= SPELLED:
            return {"".join(x) for n in range(low, high + 1) for x in product(sorted(one), repeat=n)}
        if one == {_EDGE} and low:
            return {_EDGE}
        return {s + _OPEN + t for s in one for t in one} if low and len(one) ** 2 <= SPELLED else {_OPEN}
    return {_OPEN}


def _spelled_all(items: Sequence) -> set[str]:
    out = {""}
    for op, arg in items:
        one = _spelled(op, arg)
        out = {a + b for a in out for b in one} if len(out) * len(one) <= SPELLED else {a + _OPEN for a in _closed(out)}
    return out if len(out) <= SPELLED else {_OPEN}


def _closed(strings: set[str]) -> set[str]:
    """At most one string for each set of whole tokens, where too many would be spelled."""
    kept = {_EDGE + _EDGE.join(sorted(_whole(s))) + _EDGE for s in strings}
    return kept if len(kept) * 2 <= SPELLED else {""}


def _whole(s: str) -> frozenset[str]:
    """The letters and digits that stand between edges in a spelled string: tokens of every URL that holds it."""
    s = _OPEN + s + _OPEN
    return frozenset(m.group() for m in _TOKEN.finditer(s) if s[m.start() - 1] == _EDGE and s[m.end()] == _EDGE)


def mandatory_tokens(regex: str) -> list[frozenset[str]]:
    """Alternatives, one of which each matching URL meets by holding all its tokens as whole tokens (runs of letters and
    digits). An alternative without tokens means that nothing is mandatory: the pattern must be run on every URL."""
    found = {_whole(s) for s in _spelled_all(sre_parser.parse(regex))}
    return sorted(({frozenset()} if frozenset() in found else found), key=sorted)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without '://'."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def tokens_of(url: Column) -> Column:
    return F.array_distinct(F.filter(F.split(ascii_lower(F.coalesce(url, F.lit(""))), "[^a-z0-9]+"), lambda t: t != ""))


def token_index(pages: DataFrame, url_col: str, patterns: Sequence[Pattern]) -> tuple[dict[str, list[int]], list[int]]:
    """token -> numbers of the patterns that are indexed by it: for each alternative of a pattern the token that the fewest
    URLs hold. And the patterns without mandatory tokens."""
    wanted = [mandatory_tokens(p.regex) for p in patterns]
    free = [i for i, alternatives in enumerate(wanted) if not all(alternatives)]
    asked = pages.sparkSession.createDataFrame([(t,) for t in sorted({t for w in wanted for a in w for t in a})], "token string")
    held = pages.select(F.explode(tokens_of(F.col(url_col))).alias("token"))
    rows = held.join(F.broadcast(asked), "token").groupBy("token").count().collect()  # a row for each asked token at most: MOST_RULES * SPELLED
    seen = {r["token"]: r["count"] for r in rows}
    index: dict[str, list[int]] = {}
    for i, alternatives in enumerate(wanted):
        if all(alternatives):
            for token in {min(a, key=lambda t: (seen.get(t, 0), t)) for a in alternatives}:
                index.setdefault(token, []).append(i)
    return index, free


def _judge(host_rules: Sequence[tuple[str, str]], patterns: Sequence[Pattern], index: dict[str, list[int]], free: list[int]):
    """A pandas UDF: host, path and lower-cased URL to (rule, its verdict, pattern, its verdict)."""
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for name, verdict in sorted(dict(host_rules).items(), key=lambda r: (len(r[0]), r[0]), reverse=True):  # the first that fits is the longest
        host, _, path = name.partition("/")
        by_host.setdefault(host, []).append((f"/{path}", name, verdict))

    @F.pandas_udf("rule string, rule_verdict string, pattern int, pattern_verdict string")
    def judge(hosts: pd.Series, paths: pd.Series, urls: pd.Series) -> pd.DataFrame:
        compiled: dict[int, re.Pattern] = {}  # of those that some URL of the batch asks for
        rules: list = []
        numbers: list = []
        rule_verdicts: list = []
        pattern_verdicts: list = []
        for host, path, url in zip(hosts, paths, urls, strict=True):
            labels = host.split(".")
            fits = [r for k in range(len(labels)) for r in by_host.get(".".join(labels[k:]), ()) if path.startswith(r[0])]
            rule = max(fits, key=lambda r: (len(r[1]), r[1])) if fits else None
            number = None
            if url is not None and patterns:
                candidates = sorted({*free, *(i for t in set(_TOKEN.findall(url)) for i in index.get(t, ()))})
                number = next((i for i in candidates if (compiled.get(i) or compiled.setdefault(i, re.compile(patterns[i].regex))).search(url)), None)
            rules.append(rule and rule[1])
            numbers.append(number)
            rule_verdicts.append(rule and rule[2])
            pattern_verdicts.append(None if number is None else patterns[number].verdict)
        text = {"rule": rules, "rule_verdict": rule_verdicts, "pattern_verdict": pattern_verdicts}
        out = {k: pd.Series(v, dtype=object) for k, v in text.items()} | {"pattern": pd.Series(numbers, dtype="Int32")}
        return pd.DataFrame({k: out[k] for k in ("rule", "rule_verdict", "pattern", "pattern_verdict")})

    return judge


def url_filter(pages: DataFrame, url_col: str = "url", host_rules: Sequence[tuple[str, str]] = HOST_RULES, patterns: Sequence[Pattern] = PATTERNS) -> DataFrame:
    """Judge URLs. Adds host, path, rule (of host_rules, or null), pattern (number of the deciding pattern, or null) and verdict.

    The longest host rule that fits decides (ties: the later in code-point order). Else the first pattern that matches
    decides, else the verdict is allow. Rules beyond MOST_RULES are judged by further indexes of that size. A host's labels fetch its rules and a URL's tokens its candidate patterns; only those
    are tried, so the work per URL doesn't grow with the number of rules. Patterns without mandatory tokens run on all URLs.

    Null url or none with '://': host and path are empty and no host rule fits; null matches no pattern. Rows are judged
    one by one, so repeated rows repeat; an empty table gives an empty table; clashing extra columns are replaced.
    """
    host, path = split_url(F.col(url_col))
    out = pages.withColumns({"host": host, "path": path})
    judged, fitting = [], dict(host_rules)
    names = list(fitting)
    for at in range(0, max(len(names), len(patterns), 1), MOST_RULES):
        some = patterns[at : at + MOST_RULES]
        index, free = token_index(pages, url_col, some) if some else ({}, [])
        judge = _judge([(n, fitting[n]) for n in names[at : at + MOST_RULES]], some, index, free)
        out = out.withColumn(f"_memloom_judged{at}", judge(F.col("host"), F.col("path"), ascii_lower(F.col(url_col))))
        judged.append((at, F.col(f"_memloom_judged{at}")))
    rule = F.array_max(F.array(*(F.when(j["rule"].isNotNull(), F.struct(F.length(j["rule"]).alias("n"), j["rule"].alias("rule"), j["rule_verdict"].alias("verdict"))) for _, j in judged)))
    pattern = F.array_min(F.array(*(F.when(j["pattern"].isNotNull(), F.struct((j["pattern"] + at).alias("pattern"), j["pattern_verdict"].alias("verdict"))) for at, j in judged)))
    out = out.withColumns({"_memloom_rule": rule, "_memloom_pattern": pattern})
    verdict = F.coalesce("_memloom_rule.verdict", "_memloom_pattern.verdict", F.lit("allow"))
    out = out.withColumns({"rule": F.col("_memloom_rule.rule"), "pattern": F.col("_memloom_pattern.pattern"), "verdict": verdict})
    return out.drop("_memloom_rule", "_memloom_pattern", *(f"_memloom_judged{at}" for at, _ in judged))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    rules = ", ".join(f"('{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{v}')" for r, v in HOST_RULES)
    cases = " ".join(f"WHEN regexp_matches(low, '{p.regex}') THEN '{p.verdict}'" for p in PATTERNS)
    return f"""
WITH r(rule, h, p, v) AS (VALUES {rules}), u AS (
  SELECT page_id, coalesce(url, '') AS url, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS rest FROM pages
), parts AS (
  SELECT page_id, translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), best AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(v, length(rule)) AS v FROM parts JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
)
SELECT parts.page_id, host, path, rule, coalesce(v, CASE {cases} ELSE 'allow' END) AS verdict FROM parts LEFT JOIN best ON parts.page_id = best.page_id
"""


SQL = _sql()
