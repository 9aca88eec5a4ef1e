"""Set operations over keyed tables: dedup, merge, replace, delete, retention, diff and patch."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct content: its first id and the number of copies.

    A plain hash aggregation; copies collapse in the map-side combine before the shuffle.
    """
    return docs.groupBy(content_hash(F.col(text_col)).alias("content_hash")).agg(
        F.min(id_col).alias(id_col), F.count("*").alias("copies")
    )


def duplicate_members(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every member of a duplicate group as (hash, first id, group size, id).

    Groups stay rows instead of arrays, so a group of any size is spread over tasks. Only hashes
    travel; the join's group side is unique per hash and adaptive execution splits a hot hash.
    """
    hashed = docs.select(id_col, content_hash(F.col(text_col)).alias("content_hash"))
    groups = hashed.groupBy("content_hash").agg(
        F.min(id_col).alias("first_id"), F.count("*").alias("group_size")
    ).where("group_size > 1")
    return hashed.join(groups, "content_hash")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with the same key."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def keep_latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest row per conflict key, as one aggregation with map-side combine."""
    rest = [c for c in df.columns if c not in keys]
    latest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return latest.select(*keys, "__r.*")


def replace_slice(old: DataFrame, new: DataFrame, in_slice: Column) -> DataFrame:
    """Drop the rows of a slice and insert the new ones."""
    return old.where(~F.coalesce(in_slice, F.lit(False))).unionByName(new)


def delete_matching(df: DataFrame, doomed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(doomed.select(*keys).distinct(), list(keys), "left_anti")


def delete_cascade(
    parents: DataFrame, children: Mapping[str, DataFrame], doomed: DataFrame, key: str
) -> dict[str, DataFrame]:
    """Parents and all child tables without the doomed parents' rows."""
    out = {"parents": delete_matching(parents, doomed, [key])}
    out.update({name: delete_matching(child, doomed, [key]) for name, child in children.items()})
    return out


def retain(df: DataFrame, ts: str, as_of: Column, max_age: Column) -> DataFrame:
    """Rows not older than ``max_age`` at ``as_of``."""
    return df.where(F.col(ts) >= as_of - max_age)


def unexpired(df: DataFrame, expires: str, as_of: Column) -> DataFrame:
    return df.where(F.col(expires).isNull() | (F.col(expires) >= as_of))


def merge_tables(old: DataFrame, new: DataFrame, key: str, mode: str) -> DataFrame:
    """Import rows by key: 'overwrite' and 'merge' take the new values ('merge' keeps old ones
    where the new value is missing), 'skip' keeps existing rows. ``status`` tells what happened."""
    columns = [c for c in old.columns if c != key]
    a, b = old.alias("a"), new.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    has_old, has_new = F.col(f"a.{key}").isNotNull(), F.col(f"b.{key}").isNotNull()
    pick = {
        "overwrite": lambda c: F.when(has_new, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")),
        "merge": lambda c: F.coalesce(f"b.{c}", f"a.{c}"),
        "skip": lambda c: F.when(has_old, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")),
    }[mode]
    status = (
        F.when(has_old & has_new, F.lit("skipped" if mode == "skip" else "updated"))
        .when(has_new, "imported")
        .otherwise("kept")
    )
    return joined.select(
        F.coalesce(f"a.{key}", f"b.{key}").alias(key), *[pick(c).alias(c) for c in columns], status.alias("status")
    )


def field_diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Added, removed and modified entries of two field tables."""
    a = before.select(F.col(key).alias("k"), F.col(value).alias("v"))
    b = after.select(F.col(key).alias("k"), F.col(value).alias("v"))
    j = a.alias("a").join(b.alias("b"), F.col("a.k") == F.col("b.k"), "full_outer")
    status = (
        F.when(F.col("a.k").isNull(), "added")
        .when(F.col("b.k").isNull(), "removed")
        .when(F.col("a.v").eqNullSafe(F.col("b.v")), "same")
        .otherwise("modified")
    )
    return j.select(
        F.coalesce("a.k", "b.k").alias(key), F.col("a.v").alias("before"), F.col("b.v").alias("after"),
        status.alias("status"),
    ).where("status <> 'same'")


def schema_fields(spark, df: DataFrame) -> DataFrame:
    """Column names and types of a table as rows."""
    return spark.createDataFrame(df.dtypes, "field string, type string")


def line_bag_diff(versions: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """Additions, deletions and similarity of two text versions per key.

    Lines are compared as a multiset: equal lines are counted on each side, so one aggregation
    over (key, line) replaces the alignment and a line repeated any number of times is one row.
    """
    side = lambda col, sign: versions.select(
        key, F.explode(F.split(F.coalesce(F.col(col), F.lit("")), "\n", -1)).alias("line"), F.lit(sign).alias("side")
    )
    counted = side(before, -1).unionByName(side(after, 1)).groupBy(key, "line").agg(
        F.count_if(F.col("side") < 0).alias("na"), F.count_if(F.col("side") > 0).alias("nb")
    )
    per = counted.groupBy(key).agg(
        F.sum(F.greatest(F.col("nb") - F.col("na"), F.lit(0))).alias("additions"),
        F.sum(F.greatest(F.col("na") - F.col("nb"), F.lit(0))).alias("deletions"),
        F.sum("na").alias("la"),
        F.sum("nb").alias("lb"),
    )
    changed = F.col("additions") + F.col("deletions")
    return per.select(
        key, "additions", "deletions",
        (F.lit(1.0) - changed / F.greatest(F.col("la") + F.col("lb"), F.lit(1))).alias("similarity"),
    )


def three_way_merge(base: DataFrame, ours: DataFrame, theirs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Positional merge of three line tables (keys + ``line``); conflicts keep both versions."""
    j = (
        base.withColumnRenamed("line", "b")
        .join(ours.withColumnRenamed("line", "o"), list(keys), "full_outer")
        .join(theirs.withColumnRenamed("line", "t"), list(keys), "full_outer")
        .fillna("", ["b", "o", "t"])
    )
    o, t, b = F.col("o"), F.col("t"), F.col("b")
    conflict = (o != t) & (o != b) & (t != b)
    marked = F.concat(F.lit("<<<<<<< OURS\n"), o, F.lit("\n=======\n"), t, F.lit("\n>>>>>>> THEIRS"))
    merged = F.when(o == t, o).when(o == b, t).when(t == b, o).otherwise(marked)
    return j.select(*keys, merged.alias("merged"), conflict.alias("conflict"))


def distinct_work(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(distinct argument rows, input with their hash) so that an expensive step runs once per hash."""
    hashed = df.withColumn("input_hash", F.sha2(F.to_json(F.struct(*columns)), 256))
    return hashed.select("input_hash", *columns).dropDuplicates(["input_hash"]), hashed


def apply_once(df: DataFrame, columns: Sequence[str], step) -> DataFrame:
    """Run ``step`` on distinct inputs only and join its results back to every row."""
    work, hashed = distinct_work(df, columns)
    return hashed.join(step(work).drop(*columns), "input_hash")


def patch_where(df: DataFrame, condition: Column, changes: Mapping[str, Column]) -> DataFrame:
    """Change columns of the rows that satisfy a condition."""
    return df.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in changes.items()})


def patch_from(df: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Overwrite columns by the non-null values of a patch table."""
    changed = [c for c in patch.columns if c != key]
    p = patch.select(key, *[F.col(c).alias(f"__{c}") for c in changed])
    joined = df.join(p, key, "left")
    return joined.withColumns({c: F.coalesce(f"__{c}", c) for c in changed}).drop(*[f"__{c}" for c in changed])


def equi_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    return left.join(right, list(on), how)


def owned_rows(rows: DataFrame, owners: DataFrame, key: str, owner: str, user) -> DataFrame:
    """Rows of the cases a user owns."""
    return rows.join(owners.where(F.col(owner) == user).select(key), key, "left_semi")


def hierarchy_counts(cases: DataFrame, conversations: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Case -> conversations -> documents -> chunk counts; each level is aggregated before it is joined."""
    per_doc = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    docs = documents.join(per_doc, "doc_id", "left").fillna(0, ["n_chunks"])
    per_conv = docs.groupBy("conversation_id").agg(
        F.count("*").alias("n_documents"), F.sum("n_chunks").alias("n_chunks")
    )
    conv = conversations.join(per_conv, "conversation_id", "left").fillna(0, ["n_documents", "n_chunks"])
    per_case = conv.groupBy("case_id").agg(
        F.count("*").alias("n_conversations"), F.sum("n_documents").alias("n_documents"), F.sum("n_chunks").alias("n_chunks")
    )
    return cases.join(per_case, "case_id", "left").fillna(0, ["n_conversations", "n_documents", "n_chunks"])
