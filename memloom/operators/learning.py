"""Learning: extraction of statements, insert-or-confirm, merges."""

from __future__ import annotations

from collections import namedtuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions import rules
from memloom.functions.scoring import fact_text_quality
from memloom.functions.text import contains_any, strings, words
from memloom.operators.pairs import overlapping_pairs, similar_pairs
from memloom.operators.windows import first_by
from memloom.session import keep

# What marks a statement about oneself, and how an assistant's "you" becomes "I"; the first that fits is used once.
SELF_MARKERS = (
    "i am", "i'm", "i work", "i live", "my name", "i like", "i love", "i hate", "i want", "i need", "i have", "i've been", "i'm working on", "i study",
    "i prefer", "i usually", "my job", "my hobby", "i moved", "i grew up", "i speak", "i play", "i own", "i drive", "i built", "i created",
)
TO_FIRST = (
    ("you are ", "I am "), ("you're ", "I'm "), ("you work ", "I work "), ("you live ", "I live "), ("you have ", "I have "), ("you've ", "I've "), ("you moved ", "I moved "),
    ("you grew ", "I grew "), ("you study ", "I study "), ("you own ", "I own "), ("you drive ", "I drive "), ("you speak ", "I speak "), ("your name is", "my name is"), ("your job ", "my job "),
)


def statements(messages: DataFrame, text: str, shortest: int = 10, longest: int = 500) -> DataFrame:
    """Sentences of the messages that hold a marker of self-disclosure, a row for each with its place n among the message's
    sentences; repeated sentences of a message once."""
    sentences = F.array_distinct(F.transform(F.split(F.col(text), r"\. "), lambda s: F.rtrim(F.trim(s))))
    out = messages.select("*", F.posexplode(sentences).alias("n", "statement")).withColumn("statement", F.regexp_replace("statement", r"[.,!?]+$", ""))
    size = F.length("statement")
    return out.where(contains_any(F.lower("statement"), SELF_MARKERS) & (size > shortest) & (size < longest))


def first_person(text: Column) -> Column:
    """An assistant's sentence about the user in the first person: the first phrase that occurs is replaced, once."""
    out = text
    for you, i in reversed(TO_FIRST):
        at = F.locate(you, F.lower(text))
        out = F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), F.lit(i), F.substring(text, at + len(you), F.length(text)))).otherwise(out)
    return out


def insert_or_confirm(store: DataFrame, rows: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Rows (id, content) like a stored fact confirm the most alike one (count up, confidence up by 0.1 to 1); others are
    inserted. Of alike new rows the one of least id is inserted and the others confirm it. Ids are unique over both.

    The store has id, content, confidence, confirmation_count.
    """
    new = rows.select("id", "content")
    both = store.select("id", "content", F.lit(False).alias("_new")).unionByName(new.withColumn("_new", F.lit(True)))
    pairs = keep(store.sparkSession, similar_pairs(both, "id", "content", threshold, "_new"))  # read several times
    kind = both.select("id", "_new")
    linked = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    linked = linked.join(kind.where("_new").select(F.col("id").alias("a")), "a").join(kind.select(F.col("id").alias("b"), F.col("_new").alias("_b_new")), "b")
    to_store = first_by(linked.where("not _b_new"), [F.col("a")], [F.desc(F.round("similarity", 9)), F.asc("b")]).select(F.col("a").alias("id"), F.col("b").alias("_to"))
    fresh = new.join(to_store, "id", "left_anti")
    among = linked.where("_b_new and b < a").join(fresh.select(F.col("id").alias("a")), "a", "left_semi").join(fresh.select(F.col("id").alias("b")), "b", "left_semi")
    to_new = first_by(among, [F.col("a")], [F.asc("b")]).select(F.col("a").alias("id"), F.col("b").alias("_to"))
    inserted = fresh.join(to_new, "id", "left_anti").select("id", "content", F.lit(0.8).alias("confidence"), F.lit(1).cast("long").alias("confirmation_count"))
    grown = store.select("id", "content", "confidence", F.col("confirmation_count").cast("long").alias("confirmation_count")).unionByName(inserted)
    votes = to_store.unionByName(to_new).groupBy(F.col("_to").alias("id")).agg(F.count("*").alias("_votes"))
    n = F.coalesce("_votes", F.lit(0))
    return grown.join(votes, "id", "left").select("id", "content", F.least(F.lit(1.0), F.col("confidence") + 0.1 * n).alias("confidence"), (F.col("confirmation_count") + n).alias("confirmation_count"))


def merged_messages(first: Column, second: Column, head: int = 200) -> Column:
    """Messages of both in order, those with an equal lower-cased beginning once."""
    def add(seen: Column, m: Column) -> Column:
        key = F.lower(F.substring(m, 1, head))
        return F.when(F.exists(seen, lambda s: F.lower(F.substring(s, 1, head)) == key), seen).otherwise(F.concat(seen, F.array(m)))

    return F.aggregate(F.concat(first, second), F.array().cast("array<string>"), add)


def merged_maps(kept: Column, other: Column) -> Column:
    """The kept map with the other's values where it has none."""
    return F.map_zip_with(kept, other, lambda k, a, b: F.coalesce(a, b))


def suggested_tags(text: Column, tags: tuple[str, ...] = ("work", "family", "code", "travel", "music", "health"), most: int = 5) -> Column:
    """Known tags that the text names, then its hashtags, at most so many."""
    low = F.lower(text)
    known = F.filter(strings(tags), lambda t: F.contains(low, t))
    return F.slice(F.array_distinct(F.concat(known, F.regexp_extract_all(low, F.lit(r"#([\p{L}\p{N}_]+)"), F.lit(1)))), 1, most)


def packed(items: Column, budget: int, least: int = 20) -> Column:
    """Of an ordered array of structs (id, tokens) the ids that fit: an item that doesn't fit is skipped, one below `least` dropped."""
    kinds = "struct<used:bigint,ids:array<bigint>>"
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<bigint>").alias("ids")).cast(kinds)

    def step(acc: Column, x: Column) -> Column:
        fits = (x["tokens"] >= least) & (acc["used"] + x["tokens"] <= budget)
        return F.when(fits, F.struct((acc["used"] + x["tokens"]).cast("bigint").alias("used"), F.concat(acc["ids"], F.array(x["id"].cast("bigint"))).alias("ids")).cast(kinds)).otherwise(acc)

    return F.aggregate(items, start, step, lambda acc: acc["ids"])


#: What a batch of messages does to the store of facts: rows that are new or changed, statements that wait for a review, links.
Learned = namedtuple("Learned", "changed pending links")
SUBJECT, CONFLICT, RELATED, LINKS = 0.2, 0.7, 0.3, 3


def learned(store: DataFrame, messages: DataFrame, accept: float = 0.7, review: float = 0.4, threshold: float = 0.75) -> Learned:
    """Learn from messages (id, role, text): extract statements of users, and what assistants tell them about themselves in the
    first person; gate them by quality; insert or confirm; let new facts supersede those that they contradict; link them.

    store: id, content, confidence, confirmation_count, is_superseded. A statement of quality `accept` or more is stored, one of
    `review` or more waits (pending: id, content, quality), others are dropped. A new fact meets known ones whose words are
    alike by SUBJECT at least; a conflict of CONFLICT or more supersedes the known one. links: source (new), target, weight, the
    LINKS most alike facts above RELATED for each new one. Only changed rows are returned, so a store takes them as a commit.
    Ids of facts are the message's id times 1,000 and the sentence's place.
    """
    text = F.when(F.col("role") == "assistant", F.array_join(F.filter(F.transform(F.split("text", r"\. "), lambda s: F.when(first_person(s) != s, first_person(s))), lambda s: s.isNotNull()), ". ")).otherwise(F.col("text"))
    said = statements(messages.where(F.col("role").isin("user", "human", "assistant")).select("id", text.alias("_said")), "_said")
    said = said.select((F.col("id") * 1000 + F.col("n")).alias("id"), F.col("statement").alias("content")).withColumn("quality", fact_text_quality(F.col("content")))
    spark = store.sparkSession
    said = keep(spark, said)  # each step reads what the one before has written, so plans stay small
    known = store.select("id", "content", "confidence", F.col("confirmation_count").cast("long").alias("confirmation_count"), "is_superseded")
    after = keep(spark, insert_or_confirm(known, said.where(F.round("quality", 9) >= accept), threshold))
    old = known.select(F.col("id").alias("_id"), F.col("confirmation_count").alias("_before"), "is_superseded")
    after = after.join(old, F.col("id") == F.col("_id"), "left").withColumn("_new", F.col("_id").isNull())
    sets = after.where("_new or not is_superseded").select("id", "content", "_new", F.array_distinct(words(F.col("content"))).alias("w"))
    side = lambda k: sets.select(F.col("id").alias(k), F.col("content").alias(f"_c{k}"), F.col("_new").alias(f"_n{k}"))
    both = overlapping_pairs(sets.select("id", "w"), SUBJECT).join(side("a"), "a").join(side("b"), "b").where("_na <> _nb")
    fresh, held = F.when(F.col("_na"), F.col("_ca")).otherwise(F.col("_cb")), F.when(F.col("_na"), F.col("_cb")).otherwise(F.col("_ca"))
    score = F.greatest(rules.contrary(F.lower(fresh), F.lower(held)), rules.value_change(fresh, held), rules.singular_conflict(fresh, held))
    gone = keep(spark, both.where(score >= CONFLICT).select(F.when(F.col("_na"), F.col("b")).otherwise(F.col("a")).alias("_gone")).distinct())
    after = after.join(gone, F.col("id") == F.col("_gone"), "left")
    changed = after.where("_new or _gone is not null or confirmation_count <> _before")
    changed = changed.select("id", "content", "confidence", "confirmation_count", (F.coalesce("is_superseded", F.lit(False)) | F.col("_gone").isNotNull()).alias("is_superseded"))
    like = similar_pairs(after, "id", "content", RELATED, "_new").join(after.select(F.col("id").alias("a"), F.col("_new").alias("_na")), "a").join(after.select(F.col("id").alias("b"), F.col("_new").alias("_nb")), "b")
    ends = lambda x, y: like.where(f"_n{x}").select(F.col(x).alias("source"), F.col(y).alias("target"), F.col("similarity").alias("weight"))
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc(F.round("weight", 9)), "target"))
    links = ends("a", "b").unionByName(ends("b", "a")).withColumn("_p", place).where(F.col("_p") <= LINKS).drop("_p")
    waiting = said.where((F.round("quality", 9) < accept) & (F.round("quality", 9) >= review))
    return Learned(changed, waiting.select("id", "content", "quality"), links)
