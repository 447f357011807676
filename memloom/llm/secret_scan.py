"""Secret scans through a trigram inverted index: DataFrame functions only."""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm.common import ascii_lower, keep, only_wanted, table

#: kind -> (pattern, group whose length counts, least length). A match that is too short is consumed and dropped.
RULES: dict[str, tuple[str, int, int]] = {
    "assign": (r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
    "forge": (r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    "chat": (r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    "pay": (r"[sr]k_live_[A-Za-z0-9]{16,}", 0, 24),
    "pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27),
    "jwt": (r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 35),
}
BASE = ("assign", "access", "hex")
#: Strings that a part of a pattern can stand for are spelled out up to so many.
SPELLED = 64

Query = list[list[frozenset[str]]]


def trigram_query(pattern: str) -> Query:
    """The trigrams that any match must hold, ASCII letters in lower case: a list of clauses, each a list of alternatives,
    each a set of trigrams. A text can match only if every clause has an alternative whose trigrams all occur in it.
    An empty list: nothing is mandatory, the rule needs a full scan."""
    clauses: Query = []

    def close(strings: set[str]) -> None:
        if strings and min(map(len, strings)) >= 3:
            clauses.append(sorted({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}, key=sorted))

    def spell(op, arg) -> set[str] | None:
        """All strings that an item stands for, folded, or None if they are too many."""
        if op is sre.LITERAL:
            return {chr(arg).lower() if arg < 128 else chr(arg)}
        if op is sre.IN:
            if any(o is not sre.LITERAL for o, _ in arg):
                return None
            return {chr(a).lower() if a < 128 else chr(a) for _, a in arg}
        if op is sre.SUBPATTERN:
            return spell_all(arg[3])
        if op is sre.BRANCH:
            each = [spell_all(x) for x in arg[1]]
            return None if None in each else set().union(*each)
        if op is sre.MAX_REPEAT and arg[1] <= 8 and arg[0] == arg[1] or op is sre.MAX_REPEAT and (arg[0], arg[1]) == (0, 1):
            one = spell_all(arg[2])
            return None if one is None else {"".join(x) for n in range(arg[0], arg[1] + 1) for x in product(one, repeat=n)}
        return None

    def spell_all(items) -> set[str] | None:
        out = {""}
        for op, arg in items:
            one = spell(op, arg)
            if one is None or len(out) * len(one) > SPELLED:
                return None
            out = {a + b for a in out for b in one}
        return out

    def walk(items) -> None:
        run = {""}
        for op, arg in items:
            one = spell(op, arg)
            if one is not None and len(run) * len(one) <= SPELLED:
                run = {a + b for a in run for b in one}
                continue
            close(run)
            run = {""} if one is None else one
            if op is sre.SUBPATTERN and one is None:
                walk(arg[3])
        close(run)

    walk(sre_parser.parse(pattern))
    return clauses


def _posting_rows(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index over the trigrams that some rule asks for: a row (trigram number, document) for each that occurs."""
    low = ascii_lower(F.coalesce("_text", F.lit("")))
    has = F.array_compact(F.array(*(F.when(F.contains("_low", F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams))))
    return docs.withColumn("_low", low).select("_id", "_hash", F.explode(has).alias("_trigram"))


def _matches(pattern: str, group: int, least: int, rank: int) -> Column:
    """Spans of a pattern's matches as structs (start, rank, stop), in code points: gaps and matches alternate in the text."""
    text, lit = F.coalesce("_text", F.lit("")), F.lit(pattern)
    gaps = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, lit, F.lit(0))
    part = F.regexp_extract_all(text, lit, F.lit(group)) if group else whole
    row = F.arrays_zip(F.transform(gaps, F.length).alias("g"), F.transform(whole, F.length).alias("m"), F.transform(part, F.length).alias("p"))
    start = F.struct(F.lit(0).alias("at"), _none().alias("found"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["g"]
        stop = begin + F.coalesce(x["m"], F.lit(0))
        found = F.when(x["p"] >= least, F.concat(acc["found"], F.array(F.struct(begin.alias("start"), F.lit(rank).alias("rank"), stop.alias("stop"))))).otherwise(acc["found"])
        return F.struct(stop.alias("at"), found.alias("found"))

    return F.when(F.rlike(text, lit), F.aggregate(row, start, step, lambda acc: acc["found"])).otherwise(_none())


def _none() -> Column:
    return F.array().cast("array<struct<start:int,rank:int,stop:int>>")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: dict[str, tuple[str, int, int]] = RULES) -> DataFrame:
    """Find every rule's leftmost non-overlapping matches. Returns id and spans: array of struct(kind, start, stop) by start, then rule order.

    Each rule's Boolean trigram query runs on an inverted index of the trigrams that the rules ask for; only documents whose
    postings meet it are verified with the rule's regular expression. Rules without mandatory trigrams scan every text where
    it is read. Only texts of candidates are shuffled.

    Null or empty text: no spans. Null ids and repeated rows keep one result row for each input row. Positions are code
    points, the end exclusive. An empty table gives an empty table; extra columns are not read.
    """
    queries = {kind: trigram_query(rule[0]) for kind, rule in rules.items()}
    trigrams = sorted({t for q in queries.values() for clause in q for alternative in clause for t in alternative})
    at = {t: i for i, t in enumerate(trigrams)}
    docs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_hash"))
    seen = _posting_rows(docs, trigrams).groupBy("_id", "_hash").agg(F.collect_set("_trigram").alias("_seen"))

    def holds(query: Query) -> Column:
        met = F.lit(True)
        for clause in query:
            one = F.lit(False)
            for alternative in clause:
                each = F.lit(True)
                for t in sorted(alternative):
                    each = each & F.array_contains("_seen", at[t])
                one = one | each
            met = met & one
        return met

    kinds = list(rules)
    indexed = [k for k in kinds if queries[k]]
    spans_of = lambda k: _matches(*rules[k], kinds.index(k))
    free = F.concat(_none(), *(spans_of(k) for k in kinds if k not in indexed))
    light = docs.select("_id", "_hash", free.alias("_free"))
    candidates = seen.select(F.col("_id").alias("_cid"), F.col("_hash").alias("_chash"), *(holds(queries[k]).alias(f"_may_{k}") for k in indexed))
    candidates = keep(docs.sparkSession, candidates.where(" or ".join(["false", *(f"_may_{k}" for k in indexed)])))
    texts = only_wanted(docs, candidates.select(F.col("_cid").alias("_id")))
    met = texts.join(candidates, F.col("_id").eqNullSafe(F.col("_cid")) & (F.col("_hash") == F.col("_chash")))
    found = F.concat(_none(), *(F.when(F.col(f"_may_{k}"), spans_of(k)).otherwise(_none()) for k in indexed))
    verified = met.select("_cid", "_chash", found.alias("_found")).where(F.size("_found") > 0).dropDuplicates(["_cid", "_chash"])
    joined = light.join(verified, F.col("_id").eqNullSafe(F.col("_cid")) & (F.col("_hash") == F.col("_chash")), "left")
    names = F.array(*map(F.lit, kinds))
    every = F.array_sort(F.concat("_free", F.coalesce("_found", _none())))
    spans = F.transform(every, lambda x: F.struct(F.element_at(names, x["rank"] + 1).alias("kind"), x["start"].alias("start"), x["stop"].alias("stop")))
    return joined.select(F.col("_id").alias(id_col), spans.alias("spans"))


def op5_scan_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_secrets(table(spark, sf_dir, "documents"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    return out.select("doc_id", *(count(k).alias(f"n_{k}") for k in BASE), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _sql() -> str:
    parts = []
    for rank, (kind, (pattern, group, least)) in enumerate(RULES.items()):
        p = pattern.replace("'", "''")
        parts.append(f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, start, start + m AS stop FROM (
          SELECT doc_id, m, p, sum(g) OVER w + coalesce(sum(m) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
          FROM (SELECT doc_id, unnest(range(len(ms))) AS i, unnest(list_transform(ms, lambda x: length(x))) AS m, unnest(list_transform(ps, lambda x: length(x))) AS p, unnest(list_transform(gs[1:len(ms)], lambda x: length(x))) AS g
                FROM (SELECT doc_id, regexp_extract_all(text, '{p}', 0) AS ms, regexp_extract_all(text, '{p}', {group}) AS ps, string_split_regex(text, '{p}') AS gs FROM documents WHERE text IS NOT NULL))
          WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE p >= {least}""")
    one = "kind || ':' || start::BIGINT || ':' || stop::BIGINT"
    return f"""
WITH found AS ({" UNION ALL ".join(parts)}), agg AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg({one}, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg({one}, ',' ORDER BY start, rank) AS spans
  FROM found GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN agg ON d.doc_id = agg.doc_id
"""


SQL = _sql()
