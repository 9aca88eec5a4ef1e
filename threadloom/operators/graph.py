"""Temporal property graph as two tables: vertices(id, type, name, props) and
edges(src, dst, type, valid_from, valid_to, confidence)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import ordered
from threadloom.functions.sizing import broadcast_if_small
from threadloom.operators.tables import upsert
from threadloom.session import cut_lineage


def merge_vertices(old: DataFrame, new: DataFrame) -> DataFrame:
    """Create or update by (type, name); new properties win, others stay."""
    keys = ["type", "name"]
    fresh = new.groupBy(*keys).agg(F.min("id").alias("__id"), F.max_by("props", "id").alias("__props"))
    joined = old.join(fresh, keys, "full_outer")
    props = F.when(F.col("__props").isNull(), F.col("props")).when(F.col("props").isNull(), F.col("__props")).otherwise(
        F.map_concat(F.map_filter("props", lambda k, _v: ~F.map_contains_key("__props", k)), "__props")
    )
    return joined.select(F.coalesce("id", "__id").alias("id"), *keys, props.alias("props"))


def merge_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(old, new, ["src", "type", "dst"])


def first_rows(df: DataFrame, limit: int | None) -> DataFrame:
    return df if limit is None else df.limit(limit)


def search_vertices(vertices: DataFrame, text: str, kind: str | None = None, limit: int | None = None) -> DataFrame:
    """Vertices whose name or any property value contains the text."""
    needle = F.lit(text.lower())
    hit = F.contains(F.lower("name"), needle) | F.exists(
        F.map_values("props"), lambda v: F.contains(F.lower(v), needle)
    )
    out = vertices.where(hit)
    if kind is not None:
        out = out.where(F.col("type") == kind)
    return first_rows(out.orderBy("name", "id"), limit)


def relationships(edges: DataFrame, vertex, direction: str = "both", types: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    out_edges = edges.where(F.col("src") == vertex).withColumn("direction", F.lit("out"))
    in_edges = edges.where(F.col("dst") == vertex).withColumn("direction", F.lit("in"))
    found = {"out": out_edges, "in": in_edges, "both": out_edges.unionByName(in_edges)}[direction]
    if types:
        found = found.where(F.col("type").isin(list(types)))
    return first_rows(found.orderBy("src", "dst", "type", "direction"), limit)


def valid_at(edges: DataFrame, moment: Column) -> DataFrame:
    """Edges whose validity interval contains the moment."""
    return edges.where(
        (F.col("valid_from") <= moment) & (F.col("valid_to").isNull() | (F.col("valid_to") > moment))
    )


def state_as_of(versions: DataFrame, keys: Sequence[str], ts: str, moment: Column) -> DataFrame:
    """Latest version per key recorded at or before the moment."""
    rest = [c for c in versions.columns if c not in keys]
    latest = versions.where(F.col(ts) <= moment).groupBy(*keys).agg(
        F.max_by(F.struct(*rest), ts).alias("r")
    )
    return latest.select(*keys, "r.*")


def _steps(edges: DataFrame, directed: bool) -> DataFrame:
    forward = edges.select("src", "dst")
    return forward.distinct() if directed else forward.unionByName(
        edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    ).distinct()


def neighbourhood(edges: DataFrame, start: DataFrame, depth: int = 2, directed: bool = False) -> DataFrame:
    """(root, id, hops) of every vertex within ``depth`` hops of the given roots.

    Breadth first; each hop expands only vertices first reached on the previous one. The frontier
    is broadcast while it is small and shuffled (with skew splitting for hub vertices) beyond
    that. Every hop ends in a reliable checkpoint.
    """
    steps = _steps(edges, directed)
    frontier = start.select("id").distinct().select(F.col("id").alias("root"), "id")
    seen = frontier.withColumn("hops", F.lit(0))
    for hop in range(1, depth + 1):
        reached = (
            steps.join(broadcast_if_small(frontier.withColumnRenamed("id", "src")), "src")
            .select("root", F.col("dst").alias("id"))
            .distinct()
            .join(seen.select("root", "id"), ["root", "id"], "left_anti")
        )
        frontier = cut_lineage(reached)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier.withColumn("hops", F.lit(hop)))
    return seen


def shortest_paths(
    edges: DataFrame, source, target, max_depth: int = 5, types: Sequence[str] | None = None, directed: bool = False, limit: int | None = None
) -> DataFrame:
    """Shortest paths between two vertices, all of the same minimal length or the first ``limit``.

    Breadth-first levels from the source (one row per vertex), then the vertices of each level that lie on a shortest
    path, walked back from the target, then paths along those alone. Each of them reaches the target, so the first
    ``limit`` prefixes of a level hold the prefixes of the first ``limit`` paths: no step keeps more, however many
    paths there are.
    """
    used = edges.where(F.col("type").isin(list(types))) if types else edges
    steps = _steps(used, directed)
    spark = edges.sparkSession
    kind = dict(edges.dtypes)["src"]
    empty = spark.createDataFrame([], f"hops int, path array<{kind}>")
    levels = spark.createDataFrame([(source,)], f"id {kind}").withColumn("level", F.lit(0))
    frontier = levels.select("id")
    found = None
    for hop in range(1, max_depth + 1):
        reached = (
            steps.join(broadcast_if_small(frontier.withColumnRenamed("id", "src")), "src")
            .select(F.col("dst").alias("id")).distinct()
            .join(levels.select("id"), "id", "left_anti")
        )
        frontier = cut_lineage(reached)
        levels = levels.unionByName(frontier.withColumn("level", F.lit(hop)))
        if frontier.isEmpty():
            break
        if not frontier.where(F.col("id") == target).isEmpty():
            found = hop
            break
    if found is None:
        return empty
    on_path = {found: spark.createDataFrame([(target,)], f"id {kind}")}
    for hop in range(found - 1, 0, -1):
        before = steps.join(broadcast_if_small(on_path[hop + 1].withColumnRenamed("id", "dst")), "dst").select(F.col("src").alias("id")).distinct()
        on_path[hop] = cut_lineage(before.join(levels.where(F.col("level") == hop).select("id"), "id", "left_semi"))
    paths = spark.createDataFrame([([source],)], f"path array<{kind}>")
    for hop in range(1, found + 1):
        ahead = steps.join(broadcast_if_small(paths.withColumn("src", F.element_at("path", -1))), "src").join(
            broadcast_if_small(on_path[hop].withColumnRenamed("id", "dst")), "dst")
        grown = ahead.select(F.concat("path", F.array("dst")).alias("path"))
        paths = cut_lineage(first_rows(grown.orderBy("path"), limit) if limit else grown)
    return first_rows(paths.select(F.lit(found).alias("hops"), "path").orderBy("path"), limit)


def entity_timeline(edges: DataFrame, vertices: DataFrame, vertex, start: Column, end: Column, limit: int | None = None) -> DataFrame:
    """Edges of a vertex inside a period with the other vertex, newest first."""
    touching = edges.where((F.col("src") == vertex) | (F.col("dst") == vertex))
    inside = touching.where((F.col("valid_from") >= start) & (F.col("valid_from") <= end))
    other = F.when(F.col("src") == vertex, F.col("dst")).otherwise(F.col("src"))
    named = inside.withColumn("other", other).join(
        vertices.select(F.col("id").alias("other"), F.col("name").alias("other_name")), "other", "left"
    )
    return first_rows(named.orderBy(F.desc("valid_from"), "src", "dst", "type"), limit)


def fact_contradictions(facts: DataFrame, claims: DataFrame, entity: str = "entity", text: str = "text") -> DataFrame:
    """Negating claims that share a word with a recorded fact of the same entity.

    Facts are reduced to one row per (entity, word) before they meet the claims' words, so the
    work is linear in the texts; a claim comes with its earliest conflicting fact and the number
    of shared words. ``facts`` and ``claims`` have ``id, entity, text``.
    """
    words = lambda df: df.select(
        entity, "id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), F.lit(0)))).alias("word")
    )
    negating = claims.where(F.lower(text).rlike(r"(^|[^a-z])(not|never|no|didn't|wasn't|isn't|don't)([^a-z]|$)"))
    stop = ["not", "never", "the", "and", "was", "did"]
    known = words(facts).where(~F.col("word").isin(stop)).groupBy(entity, "word").agg(F.min("id").alias("fact_id"))
    hits = words(negating).withColumnRenamed("id", "claim_id").join(known, [entity, "word"])
    return hits.groupBy(entity, "claim_id").agg(
        F.min("fact_id").alias("first_fact_id"), F.count("*").alias("shared_words")
    ).withColumn("confidence", F.lit(0.7))


def changing_relations(edges: DataFrame) -> DataFrame:
    """Relations of one source and type whose target changes over time."""
    moved = ordered.previous(
        edges, ["src", "type"], ["valid_from", "dst"], F.date_trunc("day", "valid_from"), {"previous_dst": "dst"}
    )
    return moved.where(F.col("previous_dst").isNotNull() & (F.col("previous_dst") != F.col("dst")))


def subgraph(vertices: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen vertices and the edges between them."""
    chosen = ids.select("id").distinct()
    inner = edges.join(chosen.withColumnRenamed("id", "src"), "src", "left_semi").join(
        chosen.withColumnRenamed("id", "dst"), "dst", "left_semi"
    )
    return vertices.join(chosen, "id", "left_semi"), inner


def delete_vertices(vertices: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delete vertices together with their edges."""
    doomed = ids.select("id").distinct()
    kept = edges.join(doomed.withColumnRenamed("id", "src"), "src", "left_anti").join(
        doomed.withColumnRenamed("id", "dst"), "dst", "left_anti"
    )
    return vertices.join(doomed, "id", "left_anti"), kept


def communication_graph(messages: DataFrame, sender: str = "sender", recipient: str = "recipient", ts: str = "ts") -> DataFrame:
    return messages.groupBy(F.col(sender).alias("src"), F.col(recipient).alias("dst")).agg(
        F.count("*").alias("n_messages"), F.min(ts).alias("valid_from"), F.max(ts).alias("last_at")
    ).withColumn("type", F.lit("MESSAGED"))


def mention_edges(entities: DataFrame, message_id: str = "message_id") -> DataFrame:
    entity = F.regexp_replace(F.concat_ws("-", "type", "text"), "[^a-zA-Z0-9-]", "_")
    return entities.select(entity.alias("src"), F.col(message_id).cast("string").alias("dst"), F.lit("MENTIONED_IN").alias("type")).distinct()


def lineage_roots(versions: DataFrame) -> DataFrame:
    """(id, root) of every version, root being its topmost ancestor, by pointer doubling.

    In each round a version looks at the ancestor it knows of and takes over that one's, so 2^n levels take n rounds.
    Versions that point at a root are done and are not joined again. A parent that is not in the table makes its child a
    root; versions on a cycle of parents have no root and are left out.
    """
    known = versions.select(F.col("id").alias("parent_id"), F.lit(True).alias("__there"))
    rows = versions.select("id", "parent_id").join(known.distinct(), "parent_id", "left")
    rows = rows.select("id", F.when(F.col("__there"), F.col("parent_id")).otherwise(F.col("id")).alias("up"))
    rows = cut_lineage(rows.withColumn("done", F.col("up") == F.col("id")))
    rounds = max(rows.count(), 2).bit_length() + 1
    for _ in range(rounds):
        active = rows.where("not done")
        if active.isEmpty():
            break
        above = rows.select(F.col("id").alias("up"), F.col("up").alias("higher"), F.col("done").alias("top"))
        moved = active.join(above, "up").select("id", F.col("higher").alias("up"), F.col("top").alias("done"))
        rows = cut_lineage(rows.where("done").unionByName(moved))
    return rows.where("done").select("id", F.col("up").alias("root"))


def version_lineage(versions: DataFrame, of) -> DataFrame:
    """All versions that share the root of one version, at any depth: the root and all its descendants.

    ``versions`` has ``id, parent_id, version``; ids are not repeated.
    """
    roots = cut_lineage(lineage_roots(versions))
    same = roots.join(roots.where(F.col("id") == of).select("root"), "root", "left_semi")
    return versions.join(same, "id", "left_semi").orderBy(F.desc("version"), "id")


def export_graph(documents: DataFrame, chunks: DataFrame, entities: DataFrame, keywords: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Document, Chunk, Entity and Keyword nodes with HAS_CHUNK, MENTIONS and HAS_KEYWORD edges; a null is no node."""
    entity_id = F.regexp_replace(F.concat_ws("-", "type", "text"), "[^a-zA-Z0-9-]", "_")
    node = lambda df, i, label: df.where(i.isNotNull()).select(i.cast("string").alias("id"), F.lit(label).alias("label")).dropDuplicates(["id"])
    edge = lambda df, dst, label: df.select(
        F.col("doc_id").cast("string").alias("src"), dst.cast("string").alias("dst"), F.lit(label).alias("type")
    ).distinct()
    nodes = (
        node(documents, F.col("doc_id"), "Document")
        .unionByName(node(chunks, F.col("chunk_id"), "Chunk"))
        .unionByName(node(entities, entity_id, "Entity"))
        .unionByName(node(keywords, F.col("keyword"), "Keyword"))
    )
    edges = (
        edge(chunks, F.col("chunk_id"), "HAS_CHUNK")
        .unionByName(edge(entities, entity_id, "MENTIONS"))
        .unionByName(edge(keywords, F.col("keyword"), "HAS_KEYWORD"))
    )
    return nodes, edges
