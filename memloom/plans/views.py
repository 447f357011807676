"""Facts, episodes and the other stores as views over the test tables, in DataFrame form and as SQL.

Every number is a function of a row's ids, so both forms agree. Texts are whole texts. AS_OF stands for the clock.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions.fixed import FACT_TYPES

AS_OF = "2024-02-01 00:00:00"
CATEGORIES = ("technical", "creative", "personal", "general")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def _pick(values: tuple[str, ...], n):
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def facts(spark: SparkSession, sf: str) -> DataFrame:
    """A fact for each message: short statements with types, scores and dates. source_episode is the conversation."""
    k = F.col("id")
    learned = F.timestamp_add("DAY", (k % 140).cast("int"), F.lit("2023-09-01 00:00:00").cast("timestamp_ntz"))
    return (
        table(spark, sf, "conversations")
        .select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.coalesce("text", F.lit("")).alias("content"), F.col("conv_id").alias("source_episode"))
        .withColumns({
            "fact_type": _pick(FACT_TYPES, k), "confidence": (k * 37 % 70 + 30).cast("double") / F.lit(100.0), "importance": (k * 53 % 100).cast("double") / F.lit(100.0),
            "confirmation_count": 1 + k % 6, "is_superseded": k % 17 == 0, "access_count": k % 12, "first_learned": learned,
            "last_confirmed": F.timestamp_add("DAY", (k % 11).cast("int"), learned), "category": _pick(CATEGORIES, k),
            "tags": F.filter(F.array(F.when(k % 2 == 0, F.lit("even")), F.when(k % 3 == 0, F.lit("third")), F.when(k % 5 == 0, F.lit("fifth"))), lambda t: t.isNotNull()),
        })
    )


FACTS = """facts AS (
  SELECT id, content, source_episode, ['personal','preference','professional','project','relationship','world','general'][id % 7 + 1] AS fact_type,
         (id * 37 % 70 + 30)::DOUBLE / 100.0::DOUBLE AS confidence, (id * 53 % 100)::DOUBLE / 100.0::DOUBLE AS importance, 1 + id % 6 AS confirmation_count, id % 17 = 0 AS is_superseded,
         id % 12 AS access_count, TIMESTAMP '2023-09-01' + to_days((id % 140)::INT) AS first_learned, TIMESTAMP '2023-09-01' + to_days((id % 140)::INT) + to_days((id % 11)::INT) AS last_confirmed,
         ['technical','creative','personal','general'][id % 4 + 1] AS category,
         list_filter([CASE WHEN id % 2 = 0 THEN 'even' END, CASE WHEN id % 3 = 0 THEN 'third' END, CASE WHEN id % 5 = 0 THEN 'fifth' END], lambda t: t IS NOT NULL) AS tags
  FROM (SELECT conv_id * 1000 + turn AS id, coalesce(text, '') AS content, conv_id AS source_episode FROM conversations))"""


#: Statements of the kinds that rules look for, which the messages' own words hold none of; neighbours contradict, elaborate or
#: follow each other. They stand before the messages' whole texts.
STATEMENTS = (
    "My name is Anna Berg and I'm 34 years old.", "I live in Paris, France.", "I work as a nurse, mostly nights.", "I have 2 cats and a garden.", "I've been painting for 10 years.",
    "I really like green tea and long walks.", "I never really like green tea and long walks.", "My favorite is dark chocolate.", "I'm a fan of old trains.", "I don't like cold coffee.", "I hate loud rooms!",
    "I'm building a small sailing boat.", "I'm building a small sailing boat of oak near the old harbor, and my project is called Harbor.", "I want to learn Dutch.",
    "My wife Clara was a singer in Oslo until 1999 and my best friend Tom left.", "My wife Clara is a singer in Oslo since 2021, my sister Eva works at home.",
)
_STATEMENTS_SQL = "[" + ", ".join("'" + s.replace("'", "''") + "'" for s in STATEMENTS) + "]"


def told_facts(spark: SparkSession, sf: str) -> DataFrame:
    """The facts with a statement before each whole text, so that rules of extraction and relation meet what they look for."""
    f = facts(spark, sf)
    return f.withColumn("content", F.concat(_pick(STATEMENTS, F.col("id") + F.floor(F.col("id") / 1000)), F.lit(" "), F.col("content")))


TOLD_FACTS = FACTS.replace("SELECT id, content, source_episode", f"SELECT id, {_STATEMENTS_SQL}[(id + id // 1000) % 16 + 1] || ' ' || content AS content, source_episode", 1)


def stated_facts(spark: SparkSession, sf: str) -> DataFrame:
    """All facts, and the statements of each fourth conversation as short facts of their own, so that rules over pairs of facts
    meet some that repeat, contradict, elaborate or follow each other."""
    f = facts(spark, sf)
    own = f.where("source_episode % 4 = 0").withColumns({"id": F.col("id") + 1_000_000_000, "content": _pick(STATEMENTS, F.col("id") + F.floor(F.col("id") / 1000))})
    return f.unionByName(own)


STATED_FACTS = FACTS.replace("facts AS (", "facts AS (WITH plain AS (", 1)[:-1] + f""")
  SELECT * FROM plain UNION ALL SELECT * REPLACE (id + 1000000000 AS id, {_STATEMENTS_SQL}[(id + id // 1000) % 16 + 1] AS content) FROM plain WHERE source_episode % 4 = 0)"""


def episodes(spark: SparkSession, sf: str) -> DataFrame:
    """An episode for each conversation; its messages are one row's array, which a conversation bounds."""
    k = F.col("id")
    first = F.min(F.when(F.col("role") == "user", F.struct("turn", "text")))
    grouped = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("id")).agg(first.getField("text").alias("summary"), F.count("*").alias("n_messages"))
    started = F.timestamp_add("HOUR", (-(2 + k * 7 % 2400)).cast("int"), as_of())
    return grouped.select(
        "id", F.coalesce("summary", F.lit("")).alias("summary"), "n_messages", started.alias("started_at"), F.timestamp_add("HOUR", F.lit(1), started).alias("ended_at"),
        (k % 5 - 2).alias("valence"), ((k * 31 % 100).cast("double") / F.lit(100.0)).alias("importance"), (k % 9).alias("access_count"), _pick(("alpha", "beta", "gamma", "delta", "epsilon", "zeta"), k).alias("topic"),
    )


EPISODES = """episodes AS (
  SELECT id, coalesce(summary, '') AS summary, n_messages, TIMESTAMP '2024-02-01' - to_hours((2 + id * 7 % 2400)::INT) AS started_at, TIMESTAMP '2024-02-01' - to_hours((1 + id * 7 % 2400)::INT) AS ended_at,
         id % 5 - 2 AS valence, (id * 31 % 100)::DOUBLE / 100.0::DOUBLE AS importance, id % 9 AS access_count, ['alpha','beta','gamma','delta','epsilon','zeta'][id % 6 + 1] AS topic
  FROM (SELECT conv_id AS id, arg_min(text, turn) FILTER (role = 'user') AS summary, count(*) AS n_messages FROM conversations GROUP BY conv_id))"""


def feedback(spark: SparkSession, sf: str) -> DataFrame:
    """Clicks are good and errors bad marks for a conversation's first fact."""
    e = table(spark, sf, "events").where(F.col("event_type").isin("click", "error"))
    return e.select("event_id", (F.col("event_id") % 97 * 1000).alias("fact_id"), (F.col("event_type") == "click").alias("is_positive"), "ts")


FEEDBACK = "feedback AS (SELECT event_id, event_id % 97 * 1000 AS fact_id, event_type = 'click' AS is_positive, ts FROM events WHERE event_type IN ('click', 'error'))"


def links(spark: SparkSession, sf: str) -> DataFrame:
    """Two links from each conversation's episode to others, by arithmetic on the ids."""
    ids = table(spark, sf, "conversations").select(F.col("conv_id").alias("source")).distinct()
    out = ids.select("source", F.explode(F.array(F.struct((F.col("source") * 7 + 1).alias("t"), F.lit("similar").alias("kind")), F.struct((F.col("source") * 13 + 5).alias("t"), F.lit("follows").alias("kind")))).alias("x"))
    return out.select("source", (F.col("x.t") % 100).alias("target"), F.col("x.kind").alias("kind"), ((F.col("source") % 10).cast("double") / F.lit(10.0)).alias("weight")).where("source <> target")


LINKS = """links AS (
  SELECT source, t % 100 AS target, kind, (source % 10)::DOUBLE / 10.0::DOUBLE AS weight
  FROM (SELECT source, source * 7 + 1 AS t, 'similar' AS kind FROM (SELECT DISTINCT conv_id AS source FROM conversations) UNION ALL SELECT source, source * 13 + 5, 'follows' FROM (SELECT DISTINCT conv_id AS source FROM conversations))
  WHERE source <> t % 100)"""


def activity(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


def with_views(sql: str, *views: str) -> str:
    return f"WITH {', '.join(views)} {sql}"
