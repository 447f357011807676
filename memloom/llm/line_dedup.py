"""Line dedup: DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm.common import SPACES, ascii_lower, keep, table

#: Rows of a hot line are dealt out over so many tasks when they meet its verdict; AQE cuts tasks that are still too large.
SALTS = 16


def _split(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hashed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """A row for each line whose key is long enough: _id, _text (a hash), _pos, and the key's two hashes."""
    key = ascii_lower(F.btrim("_line", F.lit(SPACES)))
    return (
        docs.select(F.col("_id"), F.col("_text"), F.posexplode("_lines").alias("_pos", "_line"))
        .select("_id", "_text", "_pos", key.alias("_key"))
        .where(F.length("_key") >= min_chars)
        .select("_id", "_text", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit("second"), "_key").alias("_h2"))
    )


def _without(lines, drops):
    """The lines that aren't at the dropped positions, joined. Both arrays are bound once, so the work grows with the lines."""
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drops)
    bound = F.array(F.struct(lines.alias("all"), left.alias("left")))
    return F.element_at(F.transform(bound, lambda b: F.array_join(F.transform(b["left"], lambda i: F.element_at(b["all"], i + 1)), "\n")), 1)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Drop lines that at least `min_docs` documents hold, but in the largest id that holds them.

    A line's key is the line without ASCII white space at both ends, A-Z lower-cased, and counts from `min_chars` code points on.
    Returns the input's columns with the text replaced, plus n_lines and n_dropped. Keys are compared by 128 hash bits. Lines
    are taken apart and hashed once; their hashes and positions are written to the shared folder.

    Null or empty text: one empty line, stays "". Null id: a document whose id is below all others. Rows that share an id are
    one document when documents are counted; each row keeps its own lines. Lines below `min_chars` always stay. An empty table
    gives an empty table. Extra columns pass through untouched; names beginning with _memloom are ours.
    """
    work = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_text"), _split(F.col(text_col)).alias("_lines"))
    lines = keep(docs.sparkSession, _hashed_lines(work, min_chars))
    common = (
        lines.groupBy("_h1", "_h2", "_id").agg(F.lit(1).alias("_one"))
        .groupBy("_h1", "_h2").agg(F.count("*").alias("_n"), F.max("_id").alias("_keep"))
        .where(F.col("_n") >= min_docs)
        .select("_h1", "_h2", "_keep", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    )
    drops = (
        lines.withColumn("_salt", F.pmod(F.xxhash64("_id", "_pos"), F.lit(SALTS)).cast("int"))
        .join(common, ["_h1", "_h2", "_salt"])
        .where(~F.col("_id").eqNullSafe(F.col("_keep")))
        .groupBy(F.col("_id").alias("_memloom_id"), F.col("_text").alias("_memloom_text"))
        .agg(F.collect_set("_pos").alias("_memloom_drops"))
    )
    joined = docs.join(drops, docs[id_col].eqNullSafe(drops["_memloom_id"]) & F.xxhash64(docs[text_col]).eqNullSafe(drops["_memloom_text"]), "left")
    split = _split(docs[text_col])
    rebuilt = F.when(F.col("_memloom_drops").isNull(), F.coalesce(docs[text_col], F.lit(""))).otherwise(_without(split, F.col("_memloom_drops")))
    others = [rebuilt.alias(text_col) if c == text_col else docs[c] for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return joined.select(*others, F.size(split).cast("long").alias("n_lines"), F.coalesce(F.size("_memloom_drops"), F.lit(0)).cast("long").alias("n_dropped"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, line, translate(trim(line, E' \t\n\x0b\f\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
), common AS (
  SELECT key, max(doc_id) AS keep FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT l.doc_id, l.pos, l.line, c.key IS NOT NULL AND l.doc_id <> c.keep AS gone FROM lines l LEFT JOIN common c ON l.key = c.key AND length(l.key) >= 20
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
