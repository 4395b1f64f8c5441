"""Snapshots, diffs, manifests and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph

DIFF_EDGES = ("CALLS", "DEPENDS_ON", "EXTENDS", "IMPLEMENTS", "USES", "CONTAINS")


def snapshot(graph: Graph) -> DataFrame:
    """One row: types and edges of the kinds that diffs count."""
    types = graph.classes().agg(F.count(F.lit(1)).alias("type_count"))
    return types.join(graph.edges.where(F.col("type").isin(*DIFF_EDGES)).agg(F.count(F.lit(1)).alias("edge_count")))


def type_changes(before: Graph, after: Graph) -> DataFrame:
    """(fqn, change): added and removed types."""
    old, new = before.classes().select("fqn"), after.classes().select("fqn")
    return new.subtract(old).select("fqn", F.lit("added").alias("change")).union(old.subtract(new).select("fqn", F.lit("removed").alias("change")))


def diff_summary(before: Graph, after: Graph) -> DataFrame:
    """Counts of a diff; edge changes follow the difference of counts, offset by the types that went or came."""
    changes = type_changes(before, after).agg(F.count_if(F.col("change") == "added").alias("added_types"), F.count_if(F.col("change") == "removed").alias("removed_types"))
    delta = snapshot(after).select(F.col("edge_count").alias("n")).join(snapshot(before).select(F.col("edge_count").alias("o"))).select((F.col("n") - F.col("o")).alias("delta"))
    rows = changes.join(delta)
    return rows.select("added_types", "removed_types", F.greatest(F.lit(0), F.col("delta") + F.col("removed_types")).alias("added_edges"), F.greatest(F.lit(0), -F.col("delta") + F.col("added_types")).alias("removed_edges"))


def edge_changes(before: Graph, after: Graph) -> DataFrame:
    """Exact edge diff by key."""
    key = ["type", "from_id", "to_id"]
    old, new = before.edges.select(*key), after.edges.select(*key)
    return new.subtract(old).withColumn("change", F.lit("added")).union(old.subtract(new).withColumn("change", F.lit("removed")))


def manifest_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, state): added, changed, deleted or unchanged, by hash."""
    both = before.alias("o").join(after.alias("n"), "path", "full_outer")
    state = F.when(F.col("o.sha256").isNull(), "added").when(F.col("n.sha256").isNull(), "deleted").when(F.col("o.sha256") != F.col("n.sha256"), "changed").otherwise("unchanged")
    return both.select("path", state.alias("state"))


def files_to_parse(diff: DataFrame) -> DataFrame:
    return diff.where(F.col("state").isin("added", "changed")).select("path")


def first_wins(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key by an explicit order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def merge_graphs(primary: Graph, secondary: Graph, repo: str = "secondary", prefix_edges: bool = False) -> Graph:
    """Secondary nodes get ids ``repo:id``; edges keep theirs unless ``prefix_edges``; methods and types of both; the primary wins."""
    nodes = primary.nodes.withColumn("seq", F.lit(0)).unionByName(secondary.nodes.withColumn("id", F.concat(F.lit(f"{repo}:"), "id")).withColumn("seq", F.lit(1)))
    theirs = secondary.edges
    if prefix_edges:
        theirs = theirs.withColumns({c: F.concat(F.lit(f"{repo}:"), c) for c in ("from_id", "to_id")})
    edges = primary.edges.withColumn("seq", F.lit(0)).unionByName(theirs.withColumn("seq", F.lit(1)))

    def both(mine: DataFrame | None, more: DataFrame | None, key: list[str]) -> DataFrame | None:
        if mine is None or more is None:
            return more if mine is None else mine
        return mine.unionByName(more.join(mine, key, "left_anti").select(*more.columns), allowMissingColumns=True)

    methods, types = both(primary.methods, secondary.methods, ["fqn", "signature"]), both(primary.types, secondary.types, ["fqn"])
    return Graph(first_wins(nodes, ["id"], ["seq"]).drop("seq"), first_wins(edges, ["type", "from_id", "to_id"], ["seq"]).drop("seq"), methods, types)


def merge_graph_json(documents: DataFrame) -> DataFrame:
    """(kind, item) of all nodes, then edges, of parsed graph documents, without dedup."""
    nodes = documents.select(F.explode("nodes").alias("x")).select(F.lit("node").alias("kind"), F.to_json("x").alias("item"))
    return nodes.union(documents.select(F.explode("edges").alias("x")).select(F.lit("edge").alias("kind"), F.to_json("x").alias("item")))
