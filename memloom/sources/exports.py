"""Readers of chat exports and writers of snapshots. Schemas are explicit; nothing is inferred from the data."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memloom.operators.stores import delete
from memloom.sources.json_array import read_json_array

CHAT = "uuid string, name string, summary string, created_at string, updated_at string, chat_messages array<struct<uuid:string,sender:string,text:string,content:array<struct<type:string,text:string>>,created_at:string>>"
TREE = "title string, conversation_id string, mapping map<string,struct<message:struct<author:struct<role:string>,content:struct<parts:array<string>>>>>"
MEMORIES = "conversations_memory string, account_uuid string, project_memories map<string,string>"
PROJECTS = "name string, description string, docs array<struct<content:string>>"

# An export's kind by keys of its first record, in the order of the checks.
KINDS = (("memories", ("conversations_memory",)), ("tree_conversations", ("mapping",)), ("conversations", ("chat_messages",)), ("projects", ("name", "docs")))


def timestamp(text: Column, fallback: Column) -> Column:
    """ISO text, with or without Z, fractions cut to six digits; the fallback where it can't be read."""
    cleaned = F.regexp_replace(F.regexp_replace(text, r"(Z|[+-]\d\d:\d\d)$", ""), r"(\.\d{6})\d+$", "$1")
    return F.coalesce(F.try_to_timestamp(cleaned).cast("timestamp_ntz"), fallback)


#: Bytes of a file's head in which the first record's keys are sought.
HEAD = 1 << 16


def detect_kind(spark: SparkSession, path: str) -> str:
    """The kind of an export file, from the keys of its first record; unknown if none fits. Only the file's head is read, so keys
    behind its first HEAD bytes are not seen."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        head = bytes(stream.readNBytes(HEAD)).decode("utf-8", "ignore")
    finally:
        stream.close()
    keys = first_keys(head)
    return next((kind for kind, need in KINDS if keys.issuperset(need)), "unknown")


def first_keys(text: str) -> set[str]:
    """The keys of the first object in a JSON text that may be cut off: strings at its own depth with a colon behind."""
    depth, keys, base = 0, set(), None
    for m in re.finditer(r'"((?:[^"\\]|\\.)*)"(\s*:)?|[{}\[\]]', text):
        token = m.group()
        if token in "{[":
            depth += 1
            base = depth if base is None and token == "{" else base
        elif token in "}]":
            depth -= 1
            if base is not None and depth < base:
                break
        elif m.group(2) and depth == base:
            keys.add(m.group(1))
    return keys


def read_chat(spark: SparkSession, path: str) -> DataFrame:
    """Conversations with their messages: content parts joined, empty messages dropped, the sender named by role."""
    return _chat(spark.read.schema(CHAT).option("multiLine", True).json(path))


def stream_chat(spark: SparkSession, path: str) -> DataFrame:
    """The same from array files of any size, each read by byte ranges in many tasks, a conversation at a time."""
    return _chat(read_json_array(spark, path, CHAT))


def _chat(raw: DataFrame) -> DataFrame:
    def message(m: Column) -> Column:
        parts = F.array_join(F.transform(F.filter(F.coalesce(m["content"], F.array().cast("array<struct<type:string,text:string>>")), lambda p: p["text"].isNotNull()), lambda p: p["text"]), "\n")
        text = F.trim(F.when(F.length(parts) > 0, parts).otherwise(F.coalesce(m["text"], F.lit(""))))
        return F.struct(F.when(m["sender"] == "human", "user").otherwise(m["sender"]).alias("role"), text.alias("content"))

    messages = F.filter(F.transform(F.coalesce("chat_messages", F.array().cast(raw.schema["chat_messages"].dataType)), message), lambda m: m["content"] != "")
    return raw.select(F.col("uuid").alias("id"), F.coalesce("name", F.lit("")).alias("name"), "summary", messages.alias("messages"), "created_at", "updated_at")


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """What users said in tree-shaped exports: a row for each message, its parts joined."""
    raw = spark.read.schema(TREE).option("multiLine", True).json(path)
    nodes = raw.select("title", "conversation_id", F.explode(F.map_values("mapping")).alias("n"))
    said = nodes.where(F.col("n.message.author.role") == "user").select("title", "conversation_id", F.trim(F.array_join("n.message.content.parts", " ")).alias("content"))
    return said.where("content <> ''")


def read_memories(spark: SparkSession, path: str) -> DataFrame:
    """Statements of a memory file: (category, content), a category for each **header**."""
    raw = spark.read.schema(MEMORIES).option("multiLine", True).json(path)
    return sections(raw.select(F.coalesce("conversations_memory", F.lit("")).alias("text")), "text")


def sections(df: DataFrame, text: str) -> DataFrame:
    """Lines under the header before them, cut into sentences; text before any header is general."""
    numbered = df.select(F.monotonically_increasing_id().alias("_doc"), F.col(text).alias("_text"))
    lines = numbered.select("_doc", F.posexplode(F.split("_text", "\n")).alias("_n", "_line"))
    header = F.regexp_extract("_line", r"^\s*\*\*(.+?)\*\*\s*$", 1)
    under = F.last(F.when(header != "", header), ignorenulls=True).over(Window.partitionBy("_doc").orderBy("_n"))
    body = lines.withColumn("category", F.coalesce(under, F.lit("general"))).where((header == "") & (F.trim("_line") != ""))
    sentence = F.explode(F.split(F.trim("_line"), r"(?<=[.!?])\s+"))
    return body.select("category", sentence.alias("content")).where("content <> ''")


def read_projects(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(PROJECTS).option("multiLine", True).json(path)
    return raw.select("name", "description", F.coalesce(F.size("docs"), F.lit(0)).alias("documents"))


def write_snapshot(df: DataFrame, folder: str, version: int) -> str:
    """A version of a store as Parquet; versions are never overwritten."""
    path = f"{folder}/version={version:06d}"
    df.write.mode("error").parquet(path)
    return path


def restore(store: DataFrame, snapshot: DataFrame, key: str) -> DataFrame:
    """The store with the snapshot's rows whose keys it lacks."""
    return store.unionByName(delete(snapshot, store, key), allowMissingColumns=True)
