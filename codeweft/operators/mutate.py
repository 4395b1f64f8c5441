"""Upserts and mutations: each gives new tables; a version is written once and never changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import class_fqn_from_method_id, simple_name
from ..graph import Graph
from .setops import first_wins

EDGE_KEY = ["type", "from_id", "to_id"]


def upsert(old: DataFrame, new: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``new`` replace those of ``old``; columns in ``keep`` stay as they were where a row existed."""
    both = old.alias("o").join(new.alias("n"), key, "full_outer").select(key, *[F.when(F.col(f"n.{key}").isNull(), F.col(f"o.{c}")).otherwise(F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")) if c in keep else F.col(f"n.{c}")).alias(c) for c in old.columns if c != key])
    return both.select(*old.columns)


def upsert_nodes(graph: Graph, new: DataFrame) -> Graph:
    """Communities stay until they are detected again; a stub becomes internal."""
    return graph.with_(nodes=upsert(graph.nodes, new, "id", ("community_id",)))


def add_edges(graph: Graph, new: DataFrame) -> Graph:
    """Edges whose (type, from, to) is not there yet; among the new, the first by ``seq``."""
    fresh = first_wins(new, EDGE_KEY, ["seq"]).drop("seq") if "seq" in new.columns else new.dropDuplicates(EDGE_KEY)
    return graph.with_(edges=graph.edges.unionByName(fresh.join(graph.edges, EDGE_KEY, "left_anti").select(*graph.edges.columns)))


def external_stubs(graph: Graph) -> DataFrame:
    """Stubs for ends of EXTENDS and IMPLEMENTS that are no node: classes and interfaces."""
    ends = graph.edges.where(F.col("type").isin("EXTENDS", "IMPLEMENTS")).select(F.col("to_id").alias("id"), F.when(F.col("type") == "IMPLEMENTS", "INTERFACE").otherwise("CLASS").alias("kind"))
    missing = ends.groupBy("id").agg(F.min("kind").alias("kind")).join(graph.nodes, "id", "left_anti")
    fqn = F.substr("id", F.lit(7))
    return missing.select("id", "kind", fqn.alias("fqn"), simple_name(fqn).alias("simple_name"), F.lit(True).alias("external"), F.lit(None).cast("long").alias("community_id"), F.lit("EXTERNAL").alias("status"))


def set_status(graph: Graph, changes: DataFrame) -> Graph:
    """(id, new_status) to nodes."""
    nodes = graph.nodes.join(changes.select("id", "new_status"), "id", "left").withColumn("status", F.coalesce("new_status", "status")).select(*graph.nodes.columns)
    return graph.with_(nodes=nodes)


def rename_methods(graph: Graph, renames: DataFrame) -> Graph:
    """(old_id, new_id): nodes and both ends of edges; provenance stays; duplicates collapse."""

    def renamed(df: DataFrame, column: str) -> DataFrame:
        to = renames.select(F.col("old_id").alias(column), F.col("new_id").alias("_new"))
        return df.join(to, column, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")

    edges = renamed(renamed(graph.edges, "from_id"), "to_id").select(*graph.edges.columns)
    return graph.with_(nodes=renamed(graph.nodes, "id").select(*graph.nodes.columns), edges=first_wins(edges, EDGE_KEY, [F.col("weight").desc(), "provenance"]))


def without(rows: DataFrame, id_, ids: DataFrame) -> DataFrame:
    """Rows whose id (an expression) is not among ``ids`` (id)."""
    return rows.withColumn("_own", id_).join(ids.select(F.col("id").alias("_own")), "_own", "left_anti").select(*rows.columns)


def delete_nodes(graph: Graph, ids: DataFrame) -> Graph:
    """Nodes and all their edges."""
    edges = graph.edges.join(ids.select(F.col("id").alias("from_id")), "from_id", "left_anti").join(ids.select(F.col("id").alias("to_id")), "to_id", "left_anti")
    return graph.with_(nodes=graph.nodes.join(ids, "id", "left_anti").select(*graph.nodes.columns), edges=edges.select(*graph.edges.columns))


def ids_of_files(graph: Graph, types: DataFrame, paths: DataFrame) -> DataFrame:
    """Ids of the types in the files, and of their methods."""
    gone = types.join(paths, types["file_path"] == paths["path"], "left_semi").select("fqn").distinct()
    owner = F.when(F.col("id").startswith("method:"), class_fqn_from_method_id(F.col("id"))).otherwise(F.col("fqn"))
    return graph.nodes.withColumn("owner", owner).join(gone.select(F.col("fqn").alias("owner")), "owner", "left_semi").select("id")


def delete_files(graph: Graph, types: DataFrame, paths: DataFrame) -> Graph:
    return delete_nodes(graph, ids_of_files(graph, types, paths))


def delete_types(graph: Graph, fqns: DataFrame) -> Graph:
    """Types with their methods and all edges of either."""
    owner = F.when(F.col("id").startswith("method:"), class_fqn_from_method_id(F.col("id"))).otherwise(F.col("fqn"))
    return delete_nodes(graph, graph.nodes.withColumn("owner", owner).join(fqns.select(F.col("fqn").alias("owner")), "owner", "left_semi").select("id"))
