"""A Merkle manifest of a table, with a witness for every row, built by aligned appends.

Rows of one group (a source) ascend by id and are the leaves of a tree of arity three: while several nodes remain, each
run of three neighbours (the last run may be shorter) becomes the digest of the run. The groups' roots, in the order of
the groups, are the leaves of one more tree of the same kind.

1. Leaves get their place by a range exchange and prefix sums, so a group of any size spreads over all tasks.
2. Places are cut into aligned blocks of 3^``levels`` leaves. A task streams through the sorted rows of its blocks and
   appends them to the block: open runs lie on a stack of levels, a node that joins a run learns the digests before it,
   and each later sibling that completes extends the witnesses of the nodes already there. Witnesses hang on open
   subtrees, not on leaves, so an append touches at most ``levels`` runs.
3. The block's root is a further append to the next level's blocks, and so on until each group has one node; the groups'
   roots are appends to the last tree.
4. On the way back each block receives the witness of its root as a header row in front of its own rows, in the same
   exchange, and hands every leaf its whole witness. A task holds one block at a time.

Digests are lower-case hex SHA-256 of the concatenated inputs. Null values are written ``-``, others as their length in
UTF-8 bytes, ``:`` and the value, so an empty text differs from a null one. Groups sort with null first, then by UTF-8
bytes; null ids come first in their group; rows that share an id follow the order of their leaf digests, and equal rows
are leaves of their own. An empty table gives an empty result. Columns that are not named are not read, and the result
has fixed columns, so they cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from threadloom.session import cut_lineage

ARITY, LEVELS = 3, 8
_WITNESS = ArrayType(StructType([StructField("index", IntegerType()), StructField("siblings", ArrayType(StringType()))]))
#: Rows a task hands on at a time.
_BATCH = 4_096


def encoded(value: Column) -> Column:
    """``-`` for null, else length in UTF-8 bytes, colon, value (integers in decimal)."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def fold(leaf: Column, witness: Column) -> Column:
    """The root that a leaf and its witness give."""

    def step(digest: Column, level: Column) -> Column:
        before = F.slice(level["siblings"], 1, level["index"])
        after = F.slice(level["siblings"], level["index"] + 1, ARITY)
        return F.sha2(F.concat(F.array_join(before, ""), digest, F.array_join(after, "")), 256)

    return F.aggregate(witness, leaf, step)


def proof_digest(witness: Column) -> Column:
    """One digest of all siblings of a witness, level by level and left to right."""
    return F.sha2(F.array_join(F.flatten(F.transform(witness, lambda level: level["siblings"])), ""), 256)


# ---------------------------------------------------------------- appends inside a block
class _Node:
    __slots__ = ("digest", "children", "index", "witness")

    def __init__(self, digest: str, children: list[_Node] | None = None):
        self.digest, self.children, self.index, self.witness = digest, children, 0, []


class Block:
    """An aligned subtree that grows by appends; witnesses of its open nodes are extended as siblings complete."""

    def __init__(self):
        self.open: list[list[_Node]] = [[]]
        self.count = 0

    def append(self, digest: str) -> None:
        self.count += 1
        self._join(0, _Node(digest))

    def _join(self, level: int, node: _Node) -> None:
        if level == len(self.open):
            self.open.append([])
        run = self.open[level]
        node.index, node.witness = len(run), [n.digest for n in run]
        for other in run:
            other.witness.append(node.digest)
        run.append(node)
        if len(run) == ARITY:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        digest = hashlib.sha256("".join(n.digest for n in run).encode()).hexdigest()
        self._join(level + 1, _Node(digest, run))

    def close(self, height: int) -> _Node:
        """Completes short runs up to ``height`` levels; the root."""
        for level in range(height):
            if self.open[level]:
                self._complete(level)
        return self.open[height][0]


def _height(n: int) -> int:
    """Levels until one node remains."""
    h = 0
    while n > 1:
        n, h = -(-n // ARITY), h + 1
    return h


def _witnesses(root: _Node, above: list[tuple[int, list[str]]]) -> Iterator[list[tuple[int, list[str]]]]:
    """The witness of every leaf from the left: its own level first, what is above the block last."""
    todo = [(root, above)]
    while todo:
        node, path = todo.pop()
        if node.children is None:
            yield path
        else:
            todo += [(c, [(c.index, c.witness), *path]) for c in reversed(node.children)]


def _steps(paths: list[list[tuple[int, list[str]]]]) -> pa.Array:
    ends, index, cuts, flat = [0], [], [0], []
    for path in paths:
        for i, siblings in path:
            index.append(i)
            flat += siblings
            cuts.append(len(flat))
        ends.append(len(index))
    siblings = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat, pa.string()))
    levels = pa.StructArray.from_arrays([pa.array(index, pa.int32()), siblings], ["index", "siblings"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), levels)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole blocks from a stream sorted by (tree, block)."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(batch["tree"].to_pylist(), batch["block"].to_pylist()))
        start = 0
        for i in range(len(keys) + 1):
            if i < len(keys) and keys[i] == last:
                continue
            if i > start:
                held.append(batch.slice(start, i - start))
            if i < len(keys):
                if held:
                    yield pa.Table.from_batches(held)
                held, last, start = [], keys[i], i
    if held:
        yield pa.Table.from_batches(held)


def _appended(table: pa.Table, levels: int) -> _Node:
    block, n = Block(), table["n"][0].as_py()
    for digest in table["digest"].to_pylist():
        block.append(digest)
    # a tree of several blocks raises each of them to its full height
    return block.close(_height(n) if n <= ARITY**levels else levels)


def _placed(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("position") / ARITY**levels))


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "position")


def _block_roots(nodes: DataFrame, levels: int) -> DataFrame:
    """The next level: (tree, position, digest, n) of the blocks' roots."""
    size = ARITY**levels
    schema = pa.schema([("tree", pa.string()), ("position", pa.int64()), ("digest", pa.string()), ("n", pa.int64())])

    def roots(batches):
        out = []
        for table in _blocks(batches):
            root = _appended(table, levels)
            out.append((table["tree"][0].as_py(), table["block"][0].as_py(), root.digest, -(-table["n"][0].as_py() // size)))
            if len(out) == _BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    rows = _sorted(_placed(nodes.select("tree", "position", "digest", "n"), levels))
    return rows.mapInArrow(roots, "tree string, position long, digest string, n long")


def _handed_down(nodes: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """Every node with its whole witness: all columns of ``nodes`` but n, and witness, subroot, root.

    ``above`` holds (tree, position, witness, subroot, root) of the blocks' roots; its rows travel as headers.
    """
    own = [f for f in nodes.schema.fields if f.name != "n"]
    given = StructType([StructField("witness", _WITNESS), StructField("subroot", StringType()), StructField("root", StringType())])
    rows = _placed(nodes, levels).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in given])
    heads = above.select(
        "tree", F.lit(-1).cast("long").alias("position"), F.col("position").alias("block"), "witness", "subroot", "root",
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in nodes.schema.fields if f.name not in ("tree", "position")],
    )
    names = [f.name for f in own]

    def hand(batches):
        for table in _blocks(batches):
            head, rest = table.slice(0, 1).to_pylist()[0], table.slice(1)
            paths = _witnesses(_appended(rest, levels), [(w["index"], w["siblings"]) for w in head["witness"]])
            for start in range(0, len(rest), _BATCH):
                part = rest.slice(start, _BATCH).combine_chunks()
                steps = _steps([next(paths) for _ in range(len(part))])
                fixed = [pa.array([head[c]] * len(part), pa.string()) for c in ("subroot", "root")]
                columns = [*[part[c].combine_chunks() for c in names], steps, *fixed]
                yield pa.RecordBatch.from_arrays(columns, [*names, "witness", "subroot", "root"])

    return _sorted(rows.unionByName(heads)).mapInArrow(hand, StructType([*[StructField(f.name, f.dataType) for f in own], *given]))


def _levels_of(leaves: DataFrame, levels: int) -> list[DataFrame]:
    """The leaves, the blocks' roots, their blocks' roots, ... until each tree has one node."""
    out = [leaves]
    while True:
        out.append(cut_lineage(_block_roots(out[-1], levels)))
        if out[-1].where("n > 1").isEmpty():
            return out


def _down(levels_of: list[DataFrame], above: DataFrame, levels: int) -> DataFrame:
    for nodes in reversed(levels_of[1:-1]):
        above = cut_lineage(_handed_down(nodes, above, levels).drop("digest"))
    return _handed_down(levels_of[0], above, levels)


def numbered(rows: DataFrame, tree: str, order: Sequence[str]) -> DataFrame:
    """Adds ``position`` and ``n``: place in the tree from 0 and number of its rows. No task needs a whole tree."""
    rows = cut_lineage(rows.withColumn("__id", F.monotonically_increasing_id()))
    keys = [tree, *order, "__id"]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = cut_lineage(ranged.drop("__id").withColumns({"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id()}))
    runs = ranged.groupBy(tree, "__part").agg(F.min("__row").alias("__first"), F.count("*").alias("__size"))
    whole = Window.partitionBy(tree)
    before = F.sum("__size").over(whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(tree, "__part", (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__shift"), F.sum("__size").over(whole).alias("n"))
    return ranged.join(runs, [tree, "__part"]).withColumn("position", F.col("__row") + F.col("__shift")).drop("__part", "__row", "__shift")


def manifest(
    rows: DataFrame, columns: Sequence[str], id: str = "doc_id", group: str = "source",
    changed: dict[str, Column] | None = None, levels: int = LEVELS,
) -> DataFrame:
    """(id, leaf, other_leaf, subroot, root, witness) of every row; ``columns`` are what a leaf's digest covers, in order.

    ``other_leaf`` is the digest with the values of ``changed`` in place of the columns they name, for a check of
    altered rows against the manifest.
    """
    other = [(changed or {}).get(c, F.col(c)) for c in columns]
    leaves = rows.select(
        F.col(id).alias("id"), F.coalesce(F.concat(F.lit("g"), F.col(group).cast("string")), F.lit("")).alias("tree"),
        leaf_digest([F.col(c) for c in columns]).alias("digest"), leaf_digest(other).alias("other_leaf"),
    )
    leaves = cut_lineage(numbered(leaves, "tree", ["id", "digest"]))
    trees = _levels_of(leaves, levels)
    top = numbered(trees[-1].select(F.lit("").alias("top"), F.col("tree").alias("name"), "digest"), "top", ["name"])
    top = cut_lineage(top.withColumnRenamed("top", "tree"))
    whole = _levels_of(top, levels)
    digest = F.col("digest")
    start = whole[-1].select("tree", "position", F.array().cast(_WITNESS).alias("witness"), digest.alias("subroot"), digest.alias("root"))
    named = _down(whole, start, levels)
    above = named.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("position"), "witness", digest.alias("subroot"), "root")
    out = _down(trees, cut_lineage(above), levels)
    return out.select(F.col("id").alias(id), F.col("digest").alias("leaf"), "other_leaf", "subroot", "root", "witness")
