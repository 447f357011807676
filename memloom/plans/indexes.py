"""Indexes of the test tables' views, built once for what the tables hold and then read by all queries."""

from __future__ import annotations

import hashlib

from pyspark.sql import SparkSession

from memloom.operators.nearest import CellIndex
from memloom.operators.postings import TextIndex, VectorIndex
from memloom.plans.views import facts, table
from memloom.session import shared_dir


def _stamp(spark: SparkSession, path: str) -> str:
    """Name, size and time of a table's files: another content has another index."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(at))
    return hashlib.sha256(repr(files).encode()).hexdigest()[:24]


def _of(kind, spark: SparkSession, sf: str, name: str, source: str = "conversations"):
    return kind(spark, f"{shared_dir(spark)}/index-{name}-{_stamp(spark, f'{sf}/{source}.parquet')}")


def text_index(spark: SparkSession, sf: str) -> TextIndex:
    """The postings of the facts' contents."""
    index = _of(TextIndex, spark, sf, "text")
    if not index.built:
        index.build(facts(spark, sf), "id", "content")
    return index


def vector_index(spark: SparkSession, sf: str) -> VectorIndex:
    index = _of(VectorIndex, spark, sf, "vectors")
    if not index.built:
        index.build(facts(spark, sf), "id", "content")
    return index


def cell_index(spark: SparkSession, sf: str) -> CellIndex:
    """The embeddings by cells."""
    index = _of(CellIndex, spark, sf, "cells", "embeddings")
    if not index.built:
        index.build(table(spark, sf, "embeddings"))
    return index
