"""Near-duplicate documents by an LSH forest of MinHash signatures.

1. Every document becomes a set of word shingles (64-bit hashes) and a signature of one byte per permutation. Equal
   sets are one class from here on.
2. The forest: each tree orders the classes by its own signature bytes. A class's candidates are its neighbours in that
   order, the ones with the longest common prefix: the depth adapts to the region, deep where many signatures are alike
   and shallow where few are, but never below ``LEAST_DEPTH``. Candidates whose whole signatures agree on about
   ``slack`` less than the threshold form loose groups; they bound what has to be compared. The order shows a class
   the ``NEIGHBOURS`` before it. A run of more classes that share the least depth and is not yet one group is then
   compared whole: the classes outside its largest group meet all of the run, in tiles of bounded size dealt to tasks
   of their own. So every pair that shares the least depth in some tree is decided, whatever the size of its region.
3. Inside a loose group the full sets are intersected exactly, block by block. Blocks of a large group are compared
   pairwise in tasks of their own, and each returns a spanning forest of the links, never all pairs.
4. Links give components; the least id of a component is its name.

A pair at a similarity of 0.85 shares four bytes in one of 16 trees with probability 0.99999, one at 0.8 with 0.9998. Words are runs of bytes
other than ASCII blanks, A-Z lower-cased. A text with fewer words than a shingle is one shingle; null texts and texts
without words have an empty set, are linked with nothing and form a component of their own. Repeated rows are copies
of each other. Null ids are never the least id of a component that has others. Empty tables give empty tables. The result has fixed columns;
other input columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm import worker_cache
from threadloom.llm.components import components
from threadloom.llm.words import between_spaces, blocks
from threadloom.session import cut_lineage

TREES, TREE_BYTES, LEAST_DEPTH, NEIGHBOURS, SLACK = 16, 6, 4, 4, 0.2
#: Classes on each side of a tile of a crowded run.
TILE_CLASSES = 3_000
#: Crowded runs (24 bytes each) that are broadcast; more are joined by a shuffle.
BROADCAST_RUNS = 400_000
#: A comparison holds at most twice this many documents and shingles (beyond one long document).
BLOCK_DOCUMENTS, BLOCK_SHINGLES = 1_500, 1_500_000
_ODD = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes."""
    words = between_spaces(pc.ascii_lower(pc.fill_null(texts, "")))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words.distinct), np.uint64, len(words.distinct))[words.index]
    out = []
    for a, b in zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist()):
        h = hashes[a:b]
        if not len(h):
            out.append(h)
            continue
        n = max(len(h) - width + 1, 1)
        code = np.full(n, min(len(h), width), np.uint64)
        for k in range(min(width, len(h))):
            code = _mix(code + h[k : k + n])
        out.append(np.unique(code))
    return out


def signature(shingles: np.ndarray, size: int) -> bytes:
    """One byte of the least hash under each permutation."""
    least = np.full(size, np.iinfo(np.uint64).max)
    for i in range(0, len(shingles), 2048):
        x = shingles[i : i + 2048, None] * _ODD[None, :size]
        x ^= x >> np.uint64(31)
        np.minimum(least, (x * np.uint64(0x9E3779B97F4A7C15)).min(axis=0), out=least)
    return (_mix(least) >> np.uint64(56)).astype(np.uint8).tobytes()


def sets_column(text: Column | str, width: int, size: int) -> Column:
    """struct<n,key,sig>: number of shingles, a 128-bit name of the set, its signature."""

    @F.arrow_udf("struct<n:bigint,key:binary,sig:binary>")
    def describe(texts: pa.Array) -> pa.Array:
        worker_cache.release()
        n, keys, sigs = [], [], []
        for block in blocks(texts, 4_000_000):
            for s in shingle_sets(block, width):
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                sigs.append(signature(s, size) if len(s) else None)
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], ["n", "key", "sig"])

    # not deterministic only in name: Spark then runs it once, not again for every field
    return describe.asNondeterministic()(text)


def shingles_column(text: Column | str, width: int) -> Column:
    """binary: the set itself, eight bytes a shingle."""

    @F.arrow_udf("binary")
    def shingles(texts: pa.Array) -> pa.Array:
        out = []
        for block in blocks(texts, 4_000_000):
            out += [s.tobytes() for s in shingle_sets(block, width)]
        return pa.array(out, pa.binary())

    return shingles(text)


# ---------------------------------------------------------------- candidates
class _Forest:
    """Union-find over keys; ``add`` says whether a link joined two groups."""

    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        path = []
        while (y := self.up.get(x, x)) != x:
            path.append(x)
            x = y
        for p in path:
            self.up[p] = x
        return x

    def add(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _neighbour_links(keys: list[bytes], sigs: np.ndarray, trees: np.ndarray, ordered: np.ndarray, least_equal: float, forest: _Forest):
    """Links between rows and the rows up to ``NEIGHBOURS`` before them: same tree, common prefix, like signatures."""
    for k in range(1, NEIGHBOURS + 1):
        if len(keys) <= k:
            break
        same = (trees[k:] == trees[:-k]) & (ordered[k:, :LEAST_DEPTH] == ordered[:-k, :LEAST_DEPTH]).all(axis=1)
        at = np.flatnonzero(same)
        equal = (sigs[at] == sigs[at + k]).mean(axis=1)
        for i in at[equal >= least_equal].tolist():
            if keys[i] != keys[i + k] and forest.add(keys[i], keys[i + k]):
                yield keys[i], keys[i + k]


def _scan(least_equal: float):
    """Scan of sorted partitions: links, and the first and last rows, whose neighbours lie in other partitions."""

    def scan(batches):
        from pyspark import TaskContext

        part, row, forest, tail, edge = TaskContext.get().partitionId(), 0, _Forest(), None, []
        schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("part", pa.int32()), ("row", pa.int64()), ("tree", pa.int32()), ("sig", pa.binary())])
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            head = row < NEIGHBOURS
            fresh = table.append_column("row", pa.array(range(row, row + len(table)), pa.int64()))
            row += len(table)
            table = pa.concat_tables([tail, fresh]) if tail is not None else fresh
            keys = table["key"].to_pylist()
            sigs = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint8).reshape(len(keys), -1)
            ordered = np.frombuffer(b"".join(table["ordered"].to_pylist()), np.uint8).reshape(len(keys), -1)
            links = list(_neighbour_links(keys, sigs, table["tree"].to_numpy(), ordered, least_equal, forest))
            if links:
                a, b = zip(*links)
                none = pa.nulls(len(a))
                yield from pa.table([pa.array(a, pa.binary()), pa.array(b, pa.binary()), none.cast(pa.int32()), none.cast(pa.int64()), none.cast(pa.int32()), none.cast(pa.binary())], schema=schema).to_batches()
            if head:
                edge.append(fresh.slice(0, NEIGHBOURS))
            tail = table.slice(max(len(table) - NEIGHBOURS, 0))
        if tail is not None:
            ends = pa.concat_tables([*edge, tail]).to_pandas().drop_duplicates("row")
            yield from pa.table(
                [pa.array(ends["key"], pa.binary()), pa.nulls(len(ends)).cast(pa.binary()), pa.array([part] * len(ends), pa.int32()),
                 pa.array(ends["row"], pa.int64()), pa.array(ends["tree"], pa.int32()), pa.array(ends["sig"], pa.binary())], schema=schema,
            ).to_batches()

    return scan


def _in_trees(classes: DataFrame, trees: int, length: int) -> DataFrame:
    """A row for each class and tree, with the first bytes of the tree's order."""
    rows = classes.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    return rows.withColumn("ordered", F.substring("sig", F.col("tree") * TREE_BYTES + 1, F.lit(length)))


def _agreeing(left: np.ndarray, right: np.ndarray, least: float):
    """Row numbers (of left, of right) of signatures that agree in a share of at least ``least`` of their bytes."""
    size = left.shape[1]
    step = max(1, 8_000_000 // max(right.size, 1))
    for i in range(0, len(left), step):
        same = (left[i : i + step, None, :] == right[None]).view(np.uint8)
        if size % 8 == 0 and size < 256:  # eight byte-wise counts in a word, then their sum
            count = (same.view(np.uint64).sum(axis=2, dtype=np.uint64) * np.uint64(0x0101010101010101)) >> np.uint64(56)
        else:
            count = same.sum(axis=2, dtype=np.int32)
        at, to = np.nonzero(count >= least * size)
        yield at + i, to


def crowded_links(classes: DataFrame, roots: DataFrame, least_equal: float, trees: int = TREES) -> DataFrame:
    """(a, b): links between the groups of ``roots`` (node, root) that the neighbours in the orders have not shown.

    Looks at runs of more than ``NEIGHBOURS`` + 1 classes that share the least depth in a tree; smaller ones are done.
    """
    named = classes.select("key", "sig").join(roots.select(F.col("node").alias("key"), "root"), "key", "left")
    named = cut_lineage(named.withColumn("root", F.coalesce("root", "key")))
    # a run by a hash: two runs of one hash would only be compared as one
    placed = _in_trees(named.withColumn("name", F.xxhash64("root")), trees, LEAST_DEPTH).withColumn("run", F.xxhash64("tree", "ordered"))
    parts = placed.groupBy("run", "name").agg(F.count("*").alias("n"))
    runs = parts.groupBy("run").agg(F.sum("n").alias("classes"), F.max(F.struct("n", "name")).alias("most"))
    rest = F.col("classes") - F.col("most.n")
    runs = cut_lineage(runs.where((F.col("classes") > NEIGHBOURS + 1) & (rest > 0)).select(
        "run", F.col("most.name").alias("most"), F.ceil(rest / TILE_CLASSES).cast("int").alias("tall"),
        F.ceil(F.col("classes") / TILE_CLASSES).cast("int").alias("wide"),
    ))
    count = runs.count()
    if not count:
        return named.where("false").select(F.col("key").alias("a"), F.col("key").alias("b"))
    # rows of four numbers: their count is their size
    rows = placed.join(F.broadcast(runs) if count <= BROADCAST_RUNS else runs, "run")
    number = lambda n: F.pmod(F.xxhash64("key"), F.col(n).cast("bigint")).cast("int")
    tile = lambda left, i, j: F.struct(F.lit(left).alias("left"), i.alias("i"), j.alias("j"))
    outside = F.transform(F.sequence(F.lit(0), F.col("wide") - 1), lambda j: tile(True, number("tall"), j))
    all_of_it = F.transform(F.sequence(F.lit(0), F.col("tall") - 1), lambda i: tile(False, i, number("wide")))
    tiles = F.when(F.col("name") != F.col("most"), F.concat(outside, all_of_it)).otherwise(all_of_it)
    rows = rows.select("run", "key", "sig", "root", F.explode(tiles).alias("tile")).select("run", "sig", "root", "tile.*")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        sigs = np.frombuffer(b"".join(frame["sig"]), np.uint8).reshape(len(frame), -1)
        mine = frame["left"].to_numpy()
        names, number = np.unique(frame["root"].to_numpy(), return_inverse=True)
        own, other, forest, links = number[mine], number[~mine], _Forest(), []
        for at, to in _agreeing(sigs[mine], sigs[~mine], least_equal):
            pairs = np.unique(own[at].astype(np.int64) * len(names) + other[to])
            for p in pairs.tolist():
                a, b = divmod(p, len(names))
                if a != b and forest.add(a, b):
                    links.append((names[a], names[b]))
        return pd.DataFrame({"a": [a for a, _ in links], "b": [b for _, b in links]})

    return rows.groupBy("run", "i", "j").applyInPandas(compare, "a binary, b binary")


def loose_groups(classes: DataFrame, threshold: float, trees: int = TREES, slack: float = SLACK) -> DataFrame:
    """(node, root): the classes (key, sig) that have candidates, and the least class of their loose group."""
    near = cut_lineage(components(loose_links(classes, threshold, trees, slack)))
    links = cut_lineage(crowded_links(classes, near, threshold - slack, trees))
    if not links.limit(1).count():
        return near
    above = components(links)
    lifted = near.join(above.select(F.col("node").alias("root"), F.col("root").alias("above")), "root", "left")
    lone = above.join(near, "node", "left_anti")
    return lifted.select("node", F.coalesce("above", "root").alias("root")).union(lone.select("node", "root"))


def loose_links(classes: DataFrame, threshold: float, trees: int = TREES, slack: float = SLACK) -> DataFrame:
    """(a, b): pairs of class keys whose signatures are neighbours in some tree and alike enough to be compared."""
    least_equal = threshold - slack
    rows = _in_trees(classes.select("key", "sig"), trees, TREE_BYTES)
    placed = rows.repartitionByRange("tree", "ordered").sortWithinPartitions("tree", "ordered", "key")
    found = cut_lineage(placed.mapInArrow(_scan(least_equal), "a binary, b binary, part int, row bigint, tree int, sig binary"))

    def across(batches):
        # a few rows of each partition, in order: the neighbours that the partitions could not see
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        rows = pa.Table.from_batches(got).to_pandas().sort_values(["part", "row"])
        sigs = np.frombuffer(b"".join(rows["sig"]), np.uint8).reshape(len(rows), -1)
        tree = rows["tree"].to_numpy()
        ordered = np.stack([s[t * TREE_BYTES : (t + 1) * TREE_BYTES] for s, t in zip(sigs, tree)])
        links = list(_neighbour_links(rows["a"].tolist(), sigs, tree, ordered, least_equal, _Forest()))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.binary()) for i in (0, 1)], ["a", "b"])

    ends = found.where("part is not null").coalesce(1).mapInArrow(across, "a binary, b binary")
    return found.where("part is null").select("a", "b").union(ends)


# ---------------------------------------------------------------- exact comparison
def _links_inside(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with 100 * intersection >= percent * union.

    The most central documents are compared with all; then every document outside the largest component so found is.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    _, code, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[code] > 1
    centre = np.bincount(owner[shared], times[code][shared], n)
    new_code = np.cumsum(times > 1) - 1
    code, owner = new_code[code[shared]], owner[shared]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    width, forest, links = int(code[-1]) + 1 if len(code) else 0, _Forest(), []

    def compare(rows: np.ndarray):
        common = np.zeros((len(rows), n), np.float32)
        step = max(256, 8_000_000 // n)
        for a in range(0, width, step):
            lo, hi = np.searchsorted(code, [a, a + step])
            dense = np.zeros((n, min(step, width - a)), np.float32)
            dense[owner[lo:hi], code[lo:hi] - a] = 1
            common += dense[rows] @ dense.T
        union = sizes[rows][:, None] + sizes[None, :] - common
        for i, j in zip(*np.nonzero(100 * common >= percent * union)):
            if rows[i] != j and forest.add(int(rows[i]), int(j)):
                links.append((int(rows[i]), int(j)))

    central = np.argsort(-centre, kind="stable")
    compare(central[:64])
    if n > 64:
        roots = np.array([forest.root(i) for i in range(n)])
        names, counts = np.unique(roots, return_counts=True)
        rest = central[64:]
        rest = rest[roots[rest] != names[np.argmax(counts)]]
        for i in range(0, len(rest), 512):
            compare(rest[i : i + 512])
    return links


def strict_links(members: DataFrame, percent: int) -> DataFrame:
    """(a, b) linking classes from (group, key, n, shingles): a spanning forest of the exact links inside groups."""
    sizes = members.groupBy("group").agg(F.count("*").alias("docs"), F.sum("n").alias("total"))
    blocks = F.greatest(F.ceil(F.col("docs") / BLOCK_DOCUMENTS), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    rows = members.join(sizes.select("group", blocks.alias("blocks")), "group")
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    # block i meets every other block; a group of one block meets itself
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    others = F.filter(others, lambda p: (p["i"] != p["j"]) | (F.col("blocks") == 1))
    rows = rows.select("group", "key", "shingles", F.explode(others).alias("pair")).select("group", "pair.i", "pair.j", "key", "shingles")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates("key").sort_values("key", ignore_index=True)
        links = _links_inside([np.frombuffer(s, np.uint64) for s in frame["shingles"]], percent) if len(frame) > 1 else []
        return pd.DataFrame({"a": [frame["key"][i] for i, _ in links], "b": [frame["key"][j] for _, j in links]})

    return rows.groupBy("group", "i", "j").applyInPandas(compare, "a binary, b binary")


def group(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, kept, component) of every row; kept: rows with the component's least id.

    ``component`` names the component by a set of its own; null for documents without words.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text"))
    known = base.select("doc_id", F.xxhash64("__text").alias("text_hash"), sets_column("__text", width, TREES * TREE_BYTES).alias("s"))
    known = cut_lineage(known.select("doc_id", "text_hash", "s.*"))
    classes = known.where("n > 0").groupBy("key").agg(
        F.min("doc_id").alias("least_id"), F.min(F.struct("doc_id", "text_hash")).alias("row"), F.first("sig").alias("sig"), F.first("n").alias("n"),
    )
    classes = cut_lineage(classes)
    loose = loose_groups(classes, percent / 100)
    # full sets of one document of each class that has candidates
    wanted = classes.join(loose.select(F.col("node").alias("key"), F.col("root").alias("group")), "key")
    wanted = wanted.select("key", "group", "n", F.col("row.doc_id").alias("__id"), F.col("row.text_hash").alias("__hash"))
    found = base.withColumn("__h", F.xxhash64("__text")).join(wanted, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__hash")))
    members = found.select("group", "key", "n", shingles_column("__text", width).alias("shingles"))
    roots = components(cut_lineage(strict_links(cut_lineage(members), percent)))
    named = classes.select("key", "least_id").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    names = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = named.join(names, "root").select("key", "component_id", F.col("root").alias("component"))
    out = known.join(named, "key", "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select(
        "doc_id", "text_hash", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
        "component",
    )


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, the one with the least id, and every row without words; all columns."""
    groups = cut_lineage(group(docs, width, percent, doc_id, text))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")).alias("row")
    winners = groups.where("component is not null").groupBy("component").agg(first).select("row.doc_id", "row.text_hash")
    stay = winners.union(groups.where("component is null").select("doc_id", "text_hash")).distinct()
    stay = stay.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    keyed = docs.withColumn("__h", F.xxhash64(text))
    out = keyed.join(stay, F.col(doc_id).eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__hash")), "left_semi")
    again = groups.where("component is not null").groupBy("doc_id", "text_hash").count().where("count > 1")
    if again.limit(1).count():  # the same row several times
        words = out.where(F.rlike(text, F.lit(r"[^\x20\x09-\x0D]"))).dropDuplicates([doc_id, "__h"])
        out = words.union(out.where(~F.coalesce(F.rlike(text, F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))))
    return out.drop("__h")
