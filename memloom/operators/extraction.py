"""Facts from what users say, from summaries and from projects, by patterns: column expressions and one explode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.functions.fixed import FACT_PATTERNS, FICTION_WORDS, SUMMARY_MARKERS
from memloom.functions.text import contains_any

#: The last run of capitalised words in a match.
NAME = r"([A-Z][A-Za-z]+(?:[\s,]+[A-Z][A-Za-z]+)*)(?:[\s,]+[a-z][A-Za-z]*)*$"
NAMED = ("name", "partner", "friend", "family_member")
SHORTEST, LONGEST = 20, 500


def _found(text: Column, pattern: str, name: bool) -> Column:
    """What each match of a pattern captures: the name at its end, or its groups."""
    group = lambda n: F.regexp_extract_all(text, F.lit(f"(?i){pattern}"), F.lit(n))
    if name:
        return F.transform(group(0), lambda m: F.regexp_replace(F.regexp_extract(m, NAME, 1), r"[\s,]+", " "))
    if pattern.replace("(?", "").count("(") > 1:
        return F.zip_with(group(1), group(2), lambda x, y: F.concat_ws(" ", F.trim(x), F.trim(y)))
    return F.transform(group(1), F.trim)


def cleaned(content: Column, names_only: bool) -> Column:
    """Without an article or filler word at the ends, without closing marks, white space as single spaces."""
    out = F.regexp_replace(F.trim(F.regexp_replace(content, r"(?i)^(a|an|the)\s+", "")), "[.,!?;:]+$", "")
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)\s+(and|or|but|so|then)\s*$", ""), r"(?i)^\s*(and|or|but|so|then)\s+", "")
    out = F.trim(F.regexp_replace(out, r"\s+", " "))
    return F.array_join(F.filter(F.split(out, " "), lambda w: F.rlike(w, F.lit("^[A-Z]"))), " ") if names_only else out


def extracted(messages: DataFrame, key: str, text: str) -> DataFrame:
    """Facts in the messages' texts: key, fact_type, subtype, content ("subtype: what"), confidence; each once for a key."""
    def kind(fact_type: str, subtype: str, name: bool, pattern: str) -> Column:
        what = lambda c: cleaned(c, subtype in NAMED)
        return F.transform(_found(F.col(text), pattern, name), lambda c: F.struct(F.lit(fact_type).alias("fact_type"), F.lit(subtype).alias("subtype"), what(c).alias("what"), F.lit(0.8 if name else 0.7).alias("confidence")))

    kinds = [kind(*p) for p in FACT_PATTERNS]
    rows = messages.where(F.col(text).isNotNull()).select(key, F.explode(F.concat(*kinds)).alias("f")).select(key, "f.*").where(F.length("what") >= 2)
    return rows.select(key, "fact_type", "subtype", F.concat_ws(": ", "subtype", "what").alias("content"), "confidence").distinct()


def from_summaries(conversations: DataFrame, key: str, name: str, summary: str) -> DataFrame:
    """Telling sentences of long summaries, with "User" as their subject, and what was discussed."""
    sentence = F.explode(F.split(F.col(summary), r"\. "))
    told = conversations.where(F.length(summary) > 50).select(key, sentence.alias("s")).withColumn("s", F.trim("s")).where(contains_any(F.lower("s"), SUMMARY_MARKERS))
    told = told.select(key, F.replace(F.replace("s", F.lit("The user "), F.lit("User ")), F.lit("they "), F.lit("User ")).alias("content")).where((F.length("content") > SHORTEST) & (F.length("content") < LONGEST))
    named = conversations.where(F.length(name) > 3).select(key, F.concat(F.lit("Discussed: "), F.col(name)).alias("content"))
    return told.unionByName(named)


def from_projects(projects: DataFrame, key: str) -> DataFrame:
    """What projects (name, description, documents) tell: fiction is named only; documents are counted."""
    name, about = F.col("name"), F.coalesce("description", F.lit(""))
    fiction = contains_any(F.lower(name), FICTION_WORDS) | contains_any(F.lower(about), FICTION_WORDS)
    working = F.when(F.length(about) <= 10, F.concat(F.lit("Has project: "), name)).when(fiction, F.concat(F.lit("Working on creative writing project: "), name)).otherwise(F.concat(F.lit("Working on project: "), name, F.lit(" - "), about))
    size = F.when(F.col("documents") > 0, F.concat(F.lit("Project '"), name, F.lit("' has "), F.col("documents").cast("string"), F.lit(" documents")))
    return projects.where(F.length("name") > 0).select(key, F.explode(F.array_compact(F.array(working, size))).alias("content"))


def memory_facts(memories: DataFrame, key: str) -> DataFrame:
    """Of memory records (general text, projects by name): a row for each statement, with its project or none."""
    general = memories.select(key, F.lit(None).cast("string").alias("project"), F.explode(F.split("conversations_memory", r"(?<=[.!?])\s+")).alias("content"))
    projects = memories.select(key, F.explode("project_memories").alias("project", "_text")).select(key, "project", F.explode(F.split("_text", r"(?<=[.!?])\s+")).alias("content"))
    return general.unionByName(projects).where("trim(content) <> ''")
