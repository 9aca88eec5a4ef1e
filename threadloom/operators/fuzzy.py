"""Join of two text columns by edit distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def deletions(text: Column, depth: int) -> Column:
    """Every string left when at most ``depth`` characters are deleted, the text itself included."""

    def one_less(v: Column) -> Column:
        places = F.when(F.length(v) > 0, F.sequence(F.lit(1), F.length(v))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.concat(F.substring(v, F.lit(1), i - 1), F.substring(v, i + 1, F.length(v))))

    if not depth:
        return F.array(text)
    return F.reduce(
        F.sequence(F.lit(1), F.lit(depth)), F.array(text),
        lambda got, _: F.array_distinct(F.concat(got, F.flatten(F.transform(got, one_less)))),
    )


def edit_pairs(left: DataFrame, right: DataFrame, distance: int = 2, left_col: str = "name", right_col: str = "name") -> DataFrame:
    """(left_text, right_text, distance, left_copies, right_copies) of all text pairs within an edit distance, exactly.

    Two texts within distance d have a common subsequence left by at most d deletions on each side, so an equi-join on
    those subsequences finds every pair; only texts within 2d meet, and the edit distance decides. Equal texts of a side
    are one row with its number of copies, so a hot value is one text. A text of n characters has some n^d / d! keys:
    meant for names, words and titles. Null texts match nothing; the empty text matches texts of at most d characters.
    """

    def keyed(df: DataFrame, column: str, side: str) -> DataFrame:
        named = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias(f"{side}_text"))
        texts = named.agg(F.count("*").alias(f"{side}_copies"))
        # a hash of the key: two keys of one hash only cost a comparison
        return texts.withColumn("__key", F.explode(deletions(F.col(f"{side}_text"), distance))).withColumn("__key", F.xxhash64("__key"))

    a, b = keyed(left, left_col, "left"), keyed(right, right_col, "right")
    close = F.abs(F.length("left_text") - F.length("right_text")) <= distance
    met = a.join(b, "__key").where(close).withColumn("distance", F.levenshtein("left_text", "right_text", distance))
    found = met.where("distance >= 0").dropDuplicates(["left_text", "right_text"])
    return found.select("left_text", "right_text", "distance", "left_copies", "right_copies")


def ranked_by_text(pairs: DataFrame) -> DataFrame:
    """The nearest right text of each left text: least distance, then text; one aggregation with map-side combine."""
    best = F.min(F.struct("distance", "right_text", "right_copies")).alias("m")
    return pairs.groupBy("left_text").agg(best).select("left_text", "m.right_text", "m.distance", "m.right_copies")
