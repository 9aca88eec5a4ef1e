"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words. A document is certain of as many whole copies as the target holds the source;
the rest of the target, R words, is sampled: inclusion odds grow with the document's size (probability
min(1, c * size), with c such that R words are expected, and the certain ones taken whole), and documents are ranked
by random odds over inclusion odds. The first of that order are taken until R words are reached, to the nearest
document. The random odds are a hash of the seed, the id and the text, so reruns agree.

No source passes through one task: the place where the order is cut is found by narrowing histograms, and only the
documents of the last, small bucket are ranked. Repeated rows share their draw and are taken or left together. Null
texts have size 0, null sources are a source of their own (last), null ids only enter the hash. Empty tables give
empty tables. Added columns replace input columns of the same name; the others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """Rows with ``__rank`` from 0 in the given order: sorted by range, numbered by part and row."""
    rows = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = rows.groupBy(part.alias("__part")).count().select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    out = rows.withColumn("__part", part).join(F.broadcast(starts), "__part")
    return out.withColumn("__rank", F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at", "__part", "__start")


def source_targets(sizes: DataFrame, weights: list[float], share: float, cap: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources by code point, null last, take the weights in turn and share ``share`` of all words; a target stops at
    ``cap`` times its source, and the excess goes to the others by weight. With r words a unit of weight, exactly
    the sources with cap * size < r * weight are full, so one number is adjusted until it stays.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__rank") % len(weights) + 1).cast("int"))
    table = cut_lineage(
        ranked(sizes, F.col("source").asc_nulls_last()).select("source", "source_size", weight.alias("__w"), (F.col("source_size") * cap).alias("__cap"))
    )
    total = (table.agg(F.sum("source_size")).first()[0] or 0) * share
    rate, full = None, F.lit(False)
    while True:
        own = table.agg(
            F.sum(F.when(~full, F.col("__w"))).alias("w"), F.sum(F.when(full, F.col("__cap"))).alias("cap"),
        ).first()
        if not own["w"]:
            rate = float("inf")
            break
        new = (total - (own["cap"] or 0.0)) / own["w"]
        if new == rate:
            break
        rate = new
        full = F.col("__cap") < F.col("__w") * F.lit(rate)
    return table.select("source", "source_size", F.when(full | F.lit(rate == float("inf")), F.col("__cap")).otherwise(F.col("__w") * F.lit(rate)).alias("target"))


def mix(
    docs: DataFrame, weights: list[float] = (5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0, seed: int = 7,
    source: str = "source", text: str = "text", doc_id: str = "doc_id", buckets: int = 1024, rows_ranked: int = 4_096,
) -> DataFrame:
    """Every row with ``size``, ``source_size``, ``target`` and ``copies`` (how often the mix takes it; 0: not at all)."""
    size, draw = word_count(F.col(text)), F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text))
    small = cut_lineage(docs.select(F.col(source).alias("source"), size.alias("size"), draw.alias("draw")))
    plan = source_targets(small.groupBy("source").agg(F.sum("size").alias("source_size")), list(weights), share, cap)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    plan = plan.withColumn("__whole", whole).withColumn("__rest", F.col("target") - F.col("__whole") * F.col("source_size"))
    plan = cut_lineage(_inclusion(small, plan))
    cuts = cut_lineage(_cuts(small, plan, buckets, rows_ranked))

    kept = docs.withColumn("size", size).withColumn("__draw", draw)
    cuts = cuts.select(F.col("source").alias("__source"), "source_size", "target", "__whole", "__scale", "__certain", "__x", "__h")
    kept = kept.drop("source_size", "target").join(cuts, F.col(source).eqNullSafe(F.col("__source")))
    x = _order(F.col("size"), F.col("__draw"))
    taken = (F.col("__x").isNotNull()) & ((x < F.col("__x")) | ((x == F.col("__x")) & (F.col("__draw") <= F.col("__h"))))
    kept = kept.withColumn("copies", F.col("__whole") + F.when(taken & (F.col("size") > 0), 1).otherwise(0))
    return kept.drop("__draw", *[c for c in cuts.columns if c.startswith("__")])


def _inclusion(small: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds ``__scale`` (c) and ``__certain`` (sizes from here on are taken for certain) to each source.

    Words by eighths of a power of two: at most a few hundred rows per source. The largest bins are certain as long as
    c * size would pass 1 in the next one.
    """
    bins = small.where("size > 0").withColumn("__bin", F.floor(F.log2("size") * 8))
    bins = bins.groupBy("source", "__bin").agg(
        F.sum("size").cast("double").alias("__s1"), F.sum(F.col("size").cast("double") * F.col("size")).alias("__s2"),
        F.min("size").alias("__least"), F.max("size").alias("__most"),
    )
    plan = plan.withColumnRenamed("source", "__source")
    up = Window.partitionBy("source").orderBy("__bin")
    bins = bins.join(plan.select("__source", "__rest"), F.col("source").eqNullSafe(F.col("__source")))
    bins = bins.withColumn("__below2", F.sum("__s2").over(up)).withColumn(
        "__above1", F.coalesce(F.sum("__s1").over(Window.partitionBy("source").orderBy(F.desc("__bin")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    )
    scale = (F.col("__rest") - F.col("__above1")) / F.col("__below2")
    bins = bins.withColumn("__c", scale).where((F.col("__c") > 0) & (F.col("__c") * F.col("__most") <= 1))
    best = bins.groupBy("source").agg(F.max_by(F.struct("__c", "__most"), "__bin").alias("b"))
    best = best.select(F.col("source").alias("__s"), F.col("b.__c").alias("__scale"), (F.col("b.__most") + 1).alias("__certain"))
    out = plan.join(best, F.col("__source").eqNullSafe(F.col("__s")), "left").drop("__s").withColumnRenamed("__source", "source")
    return out.withColumn("__scale", F.coalesce("__scale", F.lit(0.0))).withColumn("__certain", F.coalesce("__certain", F.lit(1)))


def _order(size: Column, draw: Column) -> Column:
    """Random odds over inclusion odds, q, as q / (1 + q): from 0 (certain) to 1."""
    u = (F.shiftrightunsigned(draw, 11) + F.lit(0.5)) / F.lit(2.0**53)
    p = F.least(F.col("__scale") * size, F.lit(1.0))
    q = u / (1 - u) * (1 - p) / p
    return F.when((size >= F.col("__certain")) | (p >= 1), 0.0).when(p > 0, q / (1 + q)).otherwise(1.0)


def _cuts(small: DataFrame, plan: DataFrame, buckets: int, rows_ranked: int) -> DataFrame:
    """Adds the last place taken, (``__x``, ``__h``), to each source; null where none is."""
    sampled = plan.where("__rest > 0").withColumnRenamed("source", "__source")
    rows = small.where("size > 0").join(
        sampled.select("__source", "__scale", "__certain", "__rest"), F.col("source").eqNullSafe(F.col("__source"))
    )
    # rows of one draw and place are one item
    rows = rows.select("source", "__rest", _order(F.col("size"), F.col("draw")).alias("x"), F.col("draw").alias("h"), "size")
    rows = cut_lineage(rows.groupBy("source", "__rest", "x", "h").agg(F.sum("size").alias("size")))
    state = rows.groupBy("source").agg(F.count("*").alias("__n"), F.lit(0.0).alias("__lo"), F.lit(1.0).alias("__hi"), F.lit(0).cast("long").alias("__below"))
    inside = lambda st: rows.join(
        st.withColumnRenamed("source", "__s"),
        F.col("source").eqNullSafe(F.col("__s")) & (F.col("x") >= F.col("__lo")) & (F.col("x") <= F.col("__hi")),
    )
    while True:
        state = cut_lineage(state)
        if not state.where((F.col("__n") > rows_ranked) & (F.col("__hi") > F.col("__lo"))).limit(1).count():
            break
        width = (F.col("__hi") - F.col("__lo")) / buckets
        at = F.when(width > 0, F.least(F.floor((F.col("x") - F.col("__lo")) / width), F.lit(buckets - 1))).otherwise(0)
        parts = inside(state).groupBy("source", "__rest", "__lo", "__hi", "__below", at.alias("__k")).agg(
            F.count("*").alias("__n"), F.sum("size").alias("__words"), F.min("x").alias("__a"), F.max("x").alias("__b")
        )
        up = Window.partitionBy("source").orderBy("__k").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.withColumn("__before", F.col("__below") + F.coalesce(F.sum("__words").over(up), F.lit(0)))
        # the last bucket that begins at or before the target holds the cut
        chosen = parts.where("__before <= __rest").groupBy("source").agg(F.max_by(F.struct("__n", "__a", "__b", "__before"), "__k").alias("c"))
        state = chosen.select("source", F.col("c.__n").alias("__n"), F.col("c.__a").alias("__lo"), F.col("c.__b").alias("__hi"), F.col("c.__before").alias("__below"))
    order = Window.partitionBy("source").orderBy("x", "h").rowsBetween(Window.unboundedPreceding, -1)
    last = inside(state).withColumn("__before", F.col("__below") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    last = last.where(F.col("__before") + F.col("size") / 2 <= F.col("__rest"))
    ends = last.groupBy("source").agg(F.max(F.struct("x", "h")).alias("e"))
    # a cut before the first item of its bucket takes all below the bucket
    floors = state.select("source", F.col("__lo").alias("__floor"))
    ends = floors.withColumnRenamed("source", "__s").join(ends.withColumnRenamed("source", "__t"), F.col("__s").eqNullSafe(F.col("__t")), "left")
    ends = ends.select(
        "__s", F.coalesce(F.col("e.x"), F.col("__floor")).alias("__x"), F.coalesce(F.col("e.h"), F.lit(-(2**63))).alias("__h"),
    )
    return plan.join(ends, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
