"""Merkle manifest of a dataset: a tree over the rows of each group and one over the groups, with a proof for each row.

Leaves are sorted by range; rows per group and partition, summed up, give each leaf its place in its group. Each task builds
the aligned subtrees of RUN ** DEPTH leaves that it holds whole, and the nodes of those that go on in another task; only these
ragged nodes are shuffled, by the coordinate of their subtree. Upper levels are finished DEPTH levels at a time, so a unit of
work never holds more than RUN ** DEPTH nodes, whatever the size of a group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memloom.llm.common import ascii_lower, keep, part_of, table

RUN, DEPTH = 8, 4
SUBTREE = RUN**DEPTH
LEAVES_PER_TASK = 200_000

_STEPS = pa.struct([("before", pa.string()), ("after", pa.string())])
_NODE = "_group string, _level int, _at long, _total long, _node binary"
_PROOF = "array<struct<before:string,after:string>>"


def digest(*inputs: Column) -> Column:
    """Lowercase hex sha256 of concatenated strings."""
    return F.sha2(F.concat(*inputs).cast("binary"), 256)


def encoded(value: Column) -> Column:
    """A value so that concatenations are unambiguous: - for null, else its bytes' number, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return digest(*map(encoded, values))


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf has by its proof: level by level, what stands before and after it joins it."""
    return F.aggregate(proof, leaf, lambda node, step: digest(step["before"], node, step["after"]))


def proof_digest(proof: Column) -> Column:
    return digest(F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), ""))


def _joined(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def _levels(nodes: list[str], at: int, total: int, level: int) -> list[tuple[int, list[str]]]:
    """What can be built above consecutive nodes that begin at place `at` of `total` on a level, up to DEPTH: for each level
    the place of its first node and the nodes. A parent needs all its children; the last of a level may have fewer."""
    out = [(at, nodes)]
    while level < DEPTH and total > 1 and nodes:
        stop = at + len(nodes)
        first, last = -(-at // RUN), -(-stop // RUN) if stop == total else stop // RUN
        nodes = [_joined(nodes[p * RUN - at : (p + 1) * RUN - at]) for p in range(first, last)]
        at, total, level = first, -(-total // RUN), level + 1
        out.append((at, nodes))
    return out


def _above(total: int, levels: int) -> int:
    for _ in range(levels):
        total = -(-total // RUN)
    return total


def _hex(column: pa.Array) -> list[str]:
    return [b.hex() for b in column.to_pylist()]


def _node_batch(rows: list[tuple]) -> pa.RecordBatch:
    g, level, at, total, node = zip(*rows, strict=True) if rows else ((),) * 5
    cols = [pa.array(g, pa.string()), pa.array(level, pa.int32()), pa.array(at, pa.int64()), pa.array(total, pa.int64()), pa.array([bytes.fromhex(x) for x in node], pa.binary())]
    return pa.RecordBatch.from_arrays(cols, names=["_group", "_level", "_at", "_total", "_node"])


def _local_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (group, place, total, leaf), by group and place within a task -> the nodes of whole subtrees (level DEPTH, or the
    root of a smaller group), and of others the highest nodes that can be built here."""
    held: list[str] = []
    key: tuple[str, int, int] | None = None  # group, place of the first leaf held, total
    out: list[tuple] = []

    def close() -> None:
        levels = _levels(held, key[1], key[2], 0)
        for n, (at, nodes) in enumerate(levels):
            built = range(levels[n + 1][0], levels[n + 1][0] + len(levels[n + 1][1])) if n + 1 < len(levels) else ()
            out.extend((key[0], n, at + i, _above(key[2], n), x) for i, x in enumerate(nodes) if (at + i) // RUN not in built)
        held.clear()

    for batch in batches:
        group, at, total, leaf = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy(), _hex(batch.column(3))
        if not len(at):
            continue
        code = batch.column(0).dictionary_encode().indices.to_numpy()
        cuts = np.flatnonzero((np.diff(at) != 1) | (np.diff(code) != 0) | (at[1:] % SUBTREE == 0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)], strict=True):
            if key is None or not held or (group[a], int(at[a])) != (key[0], key[1] + len(held)) or int(at[a]) % SUBTREE == 0:
                if held:
                    close()
                key = (group[a], int(at[a]), int(total[a]))
            held.extend(leaf[a:b])
        if len(out) > 10_000:
            yield _node_batch(out)
            out = []
    if held:
        close()
    if out:
        yield _node_batch(out)


def _finish(nodes: pa.Table) -> pa.Table:
    """The nodes of one subtree, of one or several levels and none below another -> the subtree's root."""
    held: list[dict[int, str]] = [{} for _ in range(DEPTH + 1)]
    levels, totals = nodes.column("_level").to_pylist(), nodes.column("_total").to_pylist()
    for level, at, node in zip(levels, nodes.column("_at").to_pylist(), _hex(nodes.column("_node")), strict=True):
        held[level][at] = node
    level = min(levels)
    total = totals[levels.index(level)]
    while level < DEPTH and total > 1:
        children: dict[int, list[str]] = {}
        for at, node in sorted(held[level].items()):
            children.setdefault(at // RUN, []).append(node)
        held[level + 1].update((parent, _joined(x)) for parent, x in children.items())
        level, total = level + 1, -(-total // RUN)
    ((at, node),) = held[level].items()
    return pa.Table.from_batches([_node_batch([(nodes.column("_group")[0].as_py(), level, at, total, node)])])


def _block(level: str = "0") -> Column:
    """The place that a node of a level up to DEPTH has on level DEPTH: the coordinate of its subtree."""
    return F.expr(f"shiftright(_at, {RUN.bit_length() - 1} * ({DEPTH} - {level}))")


def _steps_of(levels: list[tuple[int, list[str]]], at: int, total: int, n: int) -> tuple[list[str], list[str], int]:
    """What stands before and after n nodes from `at` on, for each its levels in order, up to DEPTH; and the number of levels."""
    depth, rest = 0, total
    while depth < DEPTH and rest > 1:
        depth, rest = depth + 1, -(-rest // RUN)
    whole = [[("".join(nodes[p - first : p - first + RUN])) for p in range(first, first + len(nodes), RUN)] for first, nodes in levels[:depth]]
    before, after = [], []
    for i in range(at, at + n):
        place = i
        for level in range(depth):
            run, here = whole[level][place // RUN - levels[level][0] // RUN], place % RUN * 64
            before.append(run[:here])
            after.append(run[here + 64 :])
            place //= RUN
    return before, after, depth


def _proofs(own: pa.Table, above: pa.Table) -> pa.Array:
    """Proofs of the nodes of one subtree, sorted by place: their own levels and then those of the subtree's node."""
    at, total = own.column("_at")[0].as_py(), own.column("_total")[0].as_py()
    levels = _levels(_hex(own.column("_node")), at, total, 0)
    before, after, depth = _steps_of(levels, at, total, own.num_rows)
    tail = above.column("_proof")[0].as_py()
    upper = [s["before"] for s in tail], [s["after"] for s in tail]
    if tail:
        before = [x for i in range(own.num_rows) for x in (*before[i * depth : (i + 1) * depth], *upper[0])]
        after = [x for i in range(own.num_rows) for x in (*after[i * depth : (i + 1) * depth], *upper[1])]
    each = depth + len(tail)
    steps = pa.StructArray.from_arrays([pa.array(before, pa.string()), pa.array(after, pa.string())], fields=list(_STEPS))
    return pa.ListArray.from_arrays(pa.array(np.arange(own.num_rows + 1) * each, pa.int32()), steps)


def _ranged(spark: SparkSession, leaves: DataFrame, by: list[str]) -> DataFrame:
    """Adds _at, the place of a row in its _group by the columns `by`, and _total, the rows of its group. Rows are sorted by
    range; the counts of groups per partition (rows of groups and partitions, not of leaves) give what lies before each."""
    parts = part_of(spark, leaves.count(), LEAVES_PER_TASK)
    order = ["_group", *by]
    place = F.monotonically_increasing_id()
    placed = keep(spark, leaves.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_place", place))
    part = F.shiftright("_place", 33)
    counts = placed.groupBy("_group", part.alias("_part")).agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    of_group = Window.partitionBy("_group")
    before = F.sum("_n").over(of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    shifts = keep(spark, counts.select("_group", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(of_group).alias("_total")))
    return placed.withColumn("_part", part).join(shifts, ["_group", "_part"]).withColumn("_at", F.col("_place") + F.col("_shift")).drop("_part", "_place", "_shift")


def _rounds(spark: SparkSession, leaves: DataFrame) -> list[DataFrame]:
    """Nodes of level DEPTH, 2 DEPTH, ... of all groups, until each group has one: its root."""
    local = leaves.select("_group", "_at", "_total", "_node").sortWithinPartitions("_group", "_at").mapInArrow(_local_nodes, _NODE)
    local = keep(spark, local)
    done = (F.col("_level") == DEPTH) | (F.col("_total") == 1)
    ragged = local.where(~done).groupBy("_group", _block("_level").alias("_up")).applyInArrow(_finish, _NODE)
    rounds = [keep(spark, local.where(done).unionByName(ragged).withColumn("_level", F.lit(0)))]
    while (rounds[-1].agg(F.max("_total").alias("n")).first()["n"] or 0) > 1:
        rounds.append(keep(spark, rounds[-1].groupBy("_group", _block().alias("_up")).applyInArrow(_finish, _NODE).withColumn("_level", F.lit(0))))
    return rounds


def _proved(spark: SparkSession, nodes: DataFrame, above: DataFrame, extra: list[str]) -> DataFrame:
    """Proofs of nodes from the proofs of the nodes DEPTH levels above (_group, _at, _proof): subtree by subtree."""
    names = ["_group", "_at", "_total", *extra]
    types = {f.name: f.dataType.simpleString() for f in nodes.schema.fields}

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        own = left.sort_by("_at")
        return pa.Table.from_arrays([*(own.column(c) for c in names), _proofs(own, right)], names=[*names, "_proof"])

    left = nodes.select(*names, *["_node"] * ("_node" not in names)).withColumn("_up", _block())
    right = above.select("_group", F.col("_at").alias("_up"), "_proof")
    schema = ", ".join(f"`{c}` {types[c]}" for c in names) + f", _proof {_PROOF}"
    return left.groupBy("_group", "_up").cogroup(right.groupBy("_group", "_up")).applyInArrow(run, schema)


def _tree(spark: SparkSession, leaves: DataFrame, tops: DataFrame | None, rounds: list[DataFrame], extra: list[str]) -> DataFrame:
    """Proofs of all leaves, from the proofs of the groups' roots (_group, _proof) down."""
    above = rounds[-1].select("_group", "_at", F.array().cast(_PROOF).alias("_proof"))
    if tops is not None:
        above = rounds[-1].select("_group", "_at").join(tops, "_group")
    for nodes in reversed(rounds[:-1]):
        above = keep(spark, _proved(spark, nodes, above, []))
    return _proved(spark, leaves, above, extra)


def merkle_manifest(spark: SparkSession, rows: DataFrame, group_col: str = "lang", id_col: str = "doc_id", value_cols: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), carry: tuple[str, ...] = ()) -> DataFrame:
    """A Merkle tree over the rows of each group by rising id, and one over the groups' roots by rising name (null first).
    Returns for each row: id, group, carried columns, leaf, subroot, root (hex) and proof, an array of struct(before, after):
    for each level what stands before and after the row's node among the nodes that are hashed with it, as hex text. Levels end
    at the root of all. `fold(leaf, proof)` gives the root again.

    A leaf is the digest of the encoded values of value_cols; runs of RUN nodes, or what is left of them, become their digest
    while a level has several nodes. A null id comes first in its group; equal ids follow their leaves' digests, and equal rows
    have equal leaves, so their order changes nothing. Long and empty texts are hashed where they are read; only digests, ids and
    carried columns are shuffled. An empty table gives an empty table; other columns are not read.
    """
    group = F.concat_ws(":", F.when(F.col(group_col).isNull(), "0").otherwise("1"), F.col(group_col).cast("string")).alias("_group")
    leaf = F.unhex(leaf_digest(*map(F.col, value_cols))).alias("_node")
    carried = [F.col(c).alias(f"_c{n}") for n, c in enumerate(carry)]
    names = [f"_c{n}" for n in range(len(carry))]
    leaves = keep(spark, rows.select(group, F.col(id_col).alias("_id"), F.col(group_col).alias("_name"), leaf, *carried))
    leaves = _ranged(spark, leaves, ["_id", "_node"])
    rounds = _rounds(spark, leaves)
    roots = rounds[-1].select(F.lit("").alias("_group"), F.col("_group").alias("_of"), "_node")
    tops = _ranged(spark, roots, ["_of"])
    upper = _rounds(spark, tops)
    proved = keep(spark, _tree(spark, tops, None, upper, ["_of", "_node"]).select(F.col("_of").alias("_group"), "_proof", F.col("_node").alias("_subroot")))
    leaves = leaves.join(proved.select("_group", "_subroot"), "_group")
    out = _tree(spark, leaves, proved.select("_group", "_proof"), rounds, ["_id", "_name", "_node", "_subroot", *names])
    root = upper[-1].select(F.lower(F.hex("_node")).alias("root")).first()
    hexed = lambda c: F.lower(F.hex(c))
    kept = [F.col("_id").alias(id_col), F.col("_name").alias(group_col), *(F.col(n).alias(c) for n, c in zip(names, carry, strict=True))]
    return out.select(*kept, hexed("_node").alias("leaf"), hexed("_subroot").alias("subroot"), F.lit(root["root"] if root else "").alias("root"), F.col("_proof").alias("proof"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    values = lambda text: leaf_digest(*map(F.col, ("doc_id", "source", "lang", "n_chars")), text)
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.unhex(values(ascii_lower(F.col("text")))))
    found = merkle_manifest(spark, docs.withColumn("_tampered", changed), carry=("_tampered",))
    found = found.withColumn("folded_root", fold(F.coalesce(F.lower(F.hex("_tampered")), F.col("leaf")), F.col("proof")))
    return found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql(levels: int = 8) -> str:
    """For up to RUN ** levels rows of a language and as many languages. crc32 bit by bit, as DuckDB has none."""

    def tree(name: str, start: str, part: str) -> str:
        out = [f"{name}0 AS ({start})"]
        for n in range(levels):
            out.append(f"""{name}r{n} AS (SELECT {part}, pos // {RUN} AS up, max(total) AS total, string_agg(h, '' ORDER BY pos) AS run FROM {name}{n} GROUP BY {part}, pos // {RUN})""")
            out.append(f"""{name}{n + 1} AS (SELECT {part}, up AS pos, CASE WHEN total > 1 THEN (total + {RUN - 1}) // {RUN} ELSE 1 END AS total, CASE WHEN total > 1 THEN sha256(run) ELSE run END AS h FROM {name}r{n})""")
        return ",\n".join(out)

    def climb(name: str, source: str, runs: str, on: str) -> str:
        out, last = [], source
        for n in range(levels):
            here = f"pos // {RUN**n}"
            rest = f"left(r.run, 64 * ({here} % {RUN})) || substr(r.run, 64 * ({here} % {RUN}) + 65)"
            grown = f"sha256(left(r.run, 64 * ({here} % {RUN})) || folded || substr(r.run, 64 * ({here} % {RUN}) + 65))"
            out.append(f"""{name}{n} AS (SELECT c.* REPLACE (CASE WHEN r.total > 1 THEN proof || {rest} ELSE proof END AS proof, CASE WHEN r.total > 1 THEN {grown} ELSE folded END AS folded)
              FROM {last} c JOIN {runs}r{n} r ON {on} AND r.up = c.pos // {RUN ** (n + 1)})""")
            last = f"{name}{n}"
        return ",\n".join(out)

    enc = lambda v: f"coalesce(octet_length(encode({v}::VARCHAR))::VARCHAR || ':' || {v}::VARCHAR, '-')"
    leaf = lambda text: f"sha256({' || '.join(map(enc, ('doc_id', 'source', 'lang', 'n_chars')))} || {enc(text)})"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    bit = "lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
    byte = f"lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), {bit})"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), {byte}), 4294967295)"
    return f"""
WITH leaves AS (SELECT doc_id, coalesce('1:' || lang, '0') AS g, {leaf("text")} AS h, CASE WHEN {crc} % 3 = 0 THEN {leaf(low)} END AS t FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY g) AS total FROM leaves),
{tree("a", "SELECT g, pos, total, h FROM placed", "g")},
subroots AS (SELECT g, row_number() OVER (ORDER BY encode(g)) - 1 AS pos, count(*) OVER () AS total, h FROM a{levels}),
{tree("b", "SELECT 0 AS one, pos, total, h FROM subroots", "one")},
start AS (SELECT doc_id, g, pos, h, '' AS proof, coalesce(t, h) AS folded FROM placed),
{climb("c", "start", "a", "r.g = c.g")},
upper_start AS (SELECT c.doc_id, c.h, s.h AS subroot, s.pos, c.proof, c.folded FROM c{levels - 1} c JOIN subroots s ON s.g = c.g),
{climb("e", "upper_start", "b", "true")}
SELECT doc_id, e.h AS leaf, subroot, b.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = b.h AS verified FROM e{levels - 1} e, b{levels} b
"""


SQL = _sql()
