"""Mixing sources to target weights by capped water-filling: DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memloom.llm.common import WORD, keep, part_of, table

#: Documents of a source that one task sorts when it picks the fractional repetition.
STRATUM = 4096
#: Sources that one task ranks.
RANKED = 100_000
SALTS = 16


def _weights(spark: SparkSession, sources: DataFrame, cycle: tuple[int, ...]) -> DataFrame:
    """Adds _w: the weights repeat along the sources in code-point order, null last. No task ranks all sources."""
    n = part_of(spark, 0, RANKED)
    ranged = keep(spark, sources.repartitionByRange(n, F.col("_source").asc_nulls_last()).withColumn("_part", F.spark_partition_id()))
    counts = {r["_part"]: r["n"] for r in ranged.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # at most n rows
    before, total = [], 0
    for p in range(max(counts, default=0) + 1):
        before.append(total)
        total += counts.get(p, 0)
    place = F.row_number().over(Window.partitionBy("_part").orderBy(F.col("_source").asc_nulls_last())) - 1 + F.element_at(F.array(*map(F.lit, before)), F.col("_part") + 1)
    return ranged.withColumn("_w", F.element_at(F.array(*map(F.lit, cycle)), (place % len(cycle)).cast("int") + 1).cast("long"))


def water_fill(sources: DataFrame, max_epochs: int) -> DataFrame:
    """Adds target: sources (_size, _w) share the sum of all sizes by weight, none above max_epochs times its size.

    Each round is one small aggregate: sources above their cap are clamped, and what they leave is shared by the rest.
    """
    total = sources.agg(F.sum("_size")).first()[0] or 0
    cap = (F.col("_size") * max_epochs).cast("decimal(38,0)")
    left, weight, bound = total, None, F.lit(False)
    while True:
        if weight is not None:
            bound = (F.col("_w") * F.lit(left).cast("decimal(30,0)")).cast("decimal(38,0)") > (cap * F.lit(weight).cast("decimal(12,0)")).cast("decimal(38,0)")
        row = sources.agg(F.sum(F.when(bound, 0).otherwise(F.col("_w"))).alias("w"), F.sum(F.when(bound, F.col("_size") * max_epochs).otherwise(0)).alias("c")).first()
        new = (total - (row["c"] or 0), row["w"] or 0)
        if not new[1] or new == (left, weight):
            break
        left, weight = new
    share = F.col("_w") * F.lit(float(left)) / F.lit(float(weight or 1))
    return sources.withColumn("target", F.when(bound, (F.col("_size") * max_epochs).cast("double")).otherwise(share))


def mix_sources(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cycle: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, seed: str = "mix") -> DataFrame:
    """How often each document is taken. Returns id, size, source_size, target, epochs, taken, and _memloom_text (hash of the text).

    A source's target over its size is its number of epochs: each document is taken as often as its whole part says, and a
    seeded sample is taken once more. That sample walks each stratum of a source (at most about STRATUM documents, by a
    hash of the id) in order of size and picks every 1/fraction-th document, so the words taken come near the target.

    Null text: size 0. Null source: a source of its own, the last. Null id: a document like any other. Repeated rows are
    counted and sampled one by one. All sizes 0: targets 0, nothing taken. An empty table gives an empty table. A rerun
    gives the same result. Extra columns are not read.
    """
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    light = docs.select(
        F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), F.xxhash64(text_col).alias("_memloom_text"), digest.alias("_order"),
        F.regexp_count(F.coalesce(text_col, F.lit("")), F.lit(WORD)).cast("long").alias("_words"),
    )
    light = keep(spark, light)
    sources = light.groupBy("_source").agg(F.sum("_words").alias("_size"), F.count("*").alias("_docs"))
    sources = keep(spark, water_fill(keep(spark, _weights(spark, sources, cycle)), max_epochs))
    sources = sources.select(F.col("_source").alias("_name"), "_size", "_docs", "target")
    # A hot source meets its one row on many tasks: the small side is repeated for each salt.
    spread = sources.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    key = F.conv(F.substring("_order", 1, 8), 16, 10).cast("long")
    met = light.withColumn("_own_salt", F.pmod(key, F.lit(SALTS)).cast("int")).join(spread, F.col("_source").eqNullSafe(F.col("_name")) & (F.col("_own_salt") == F.col("_salt")))
    stratum = key % F.ceil(F.col("_docs") / F.lit(float(STRATUM))).cast("long")
    epochs = F.when(F.col("_size") > 0, F.col("target") / F.col("_size")).otherwise(0.0)
    part = F.col("epochs") - F.floor("epochs")
    place = F.row_number().over(Window.partitionBy("_source", "_stratum").orderBy("_words", "_order", "_memloom_text"))
    start = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce("_source", F.lit("")), F.col("_stratum").cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    picked = F.floor(F.col("_place") * part + F.col("_start")) - F.floor((F.col("_place") - 1) * part + F.col("_start"))
    return (
        met.select("_id", "_source", "_words", "_size", "target", "_order", "_memloom_text", stratum.alias("_stratum"), epochs.alias("epochs"))
        .withColumn("_place", place).withColumn("_start", start)
        .select(F.col("_id").alias(id_col), F.col("_words").alias("size"), F.col("_size").alias("source_size"), "target", "epochs",
                (F.floor("epochs") + picked).cast("long").alias("times"), (F.col("_words") * (F.floor("epochs") + picked)).cast("long").alias("taken"), "_memloom_text")
    )


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark, table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS h, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), s AS (
  SELECT source, s, n, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS w
  FROM (SELECT source, sum(size)::BIGINT AS s, count(*) AS n FROM d GROUP BY source)
), o AS (
  SELECT *, row_number() OVER (ORDER BY 30 * s // w, source NULLS LAST) AS k FROM s
), p AS (
  SELECT *, (SELECT sum(s) FROM o) - coalesce(sum(3 * s) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest, sum(w) OVER (ORDER BY k DESC) AS weight FROM o
), cut AS (
  SELECT rest, weight, k FROM p WHERE w * rest <= 3 * s * weight ORDER BY k LIMIT 1
), t AS (
  SELECT source, s, n, CASE WHEN k < (SELECT k FROM cut) THEN (3 * s)::DOUBLE ELSE w::DOUBLE * (SELECT rest FROM cut)::DOUBLE / (SELECT weight FROM cut)::DOUBLE END AS target FROM p
), m AS (
  SELECT d.doc_id, d.size, d.h, t.source, t.s, t.target, CASE WHEN t.s > 0 THEN t.target / t.s ELSE 0.0 END AS q, ('0x' || substr(d.h, 1, 8))::BIGINT % ceil(t.n / 4096.0)::BIGINT AS stratum
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), r AS (
  SELECT *, row_number() OVER (PARTITION BY source, stratum ORDER BY size, h) AS i, ('0x' || substr(md5('mix:' || coalesce(source, '') || ':' || stratum::VARCHAR), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u FROM m
)
SELECT doc_id, size, s AS source_size, target, (size * (floor(q) + floor(i * (q - floor(q)) + u) - floor((i - 1) * (q - floor(q)) + u)))::BIGINT AS taken FROM r
"""
