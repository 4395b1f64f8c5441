"""From source files to a graph: types, methods, structural edges, stubs, technologies, similarity, communities."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import class_fqn_from_method_id, class_id, endpoint_class, method_id, tech_id
from ..graph import Graph
from ..operators import analysis as A
from ..operators import community as C
from ..operators import lookups as L
from ..operators import mutate as M
from ..operators import setops as D
from ..operators import vectors as V
from ..sources import files as S
from ..sources.java import extract_types
from ..storage import pinned


@dataclass(frozen=True)
class BuildOptions:
    backend: str | None = None
    incremental: bool = False
    deep: bool = False
    clustering: str = "label-propagation"
    cluster: bool = True
    embed: bool = False
    no_viz: bool = False
    wiki: bool = False
    svg: bool = False
    graphml: bool = False
    neo4j: bool = False
    benchmark: bool = False


def methods_of(types: DataFrame) -> DataFrame:
    m = types.select("fqn", F.explode("methods").alias("m"))
    return m.select("fqn", "m.name", "m.signature", "m.return_type", "m.raw_body", F.col("m.internal_method_calls").alias("calls"), "m.constructor").dropDuplicates(["fqn", "signature"])


def _edges(rows: DataFrame, kind: str, a, b, weight: float) -> DataFrame:
    return rows.select(F.lit(kind).alias("type"), a.alias("from_id"), b.alias("to_id"), F.lit(weight).alias("weight"), F.lit("EXTRACTED").alias("provenance"), F.lit(1.0).alias("confidence_score")).distinct()


def _imports(types: DataFrame) -> DataFrame:
    """(fqn, other) of single-type imports."""
    each = types.select("fqn", F.explode(F.filter("import_nodes", lambda i: ~i["is_wildcard"] & ~i["is_static"])).alias("i")).select("fqn", F.col("i.name").alias("other"))
    return each.where("fqn <> other")


def graph_of(types: DataFrame, rules: DataFrame | None = None, known: DataFrame | None = None, stubs: bool = True) -> Graph:
    """The graph of parsed types. Calls link methods of one type; imports link only known types (``known``: fqn; else the types themselves)."""
    types = types.dropDuplicates(["fqn"])
    m = methods_of(types)
    own = types.select("fqn", class_id(F.col("fqn")).alias("id"))
    asked = m.select("fqn", "signature", F.explode("calls").alias("callee"))
    called = asked.join(m.select("fqn", F.col("name").alias("callee"), F.col("signature").alias("to_signature")), ["fqn", "callee"])
    known = _imports(types).join((types if known is None else known).select(F.col("fqn").alias("other")), "other", "left_semi")
    edges = (
        _edges(m, "CONTAINS", class_id(F.col("fqn")), method_id(F.col("fqn"), F.col("signature")), 1.0)
        .union(_edges(called, "CALLS", method_id(F.col("fqn"), F.col("signature")), method_id(F.col("fqn"), F.col("to_signature")), 2.0))
        .union(_edges(known, "DEPENDS_ON", class_id(F.col("fqn")), class_id(F.col("other")), 3.0))
        .union(_edges(types.where("super_class IS NOT NULL"), "EXTENDS", class_id(F.col("fqn")), class_id(F.col("super_class")), 1.0))
        .union(_edges(types.select("fqn", F.explode("interfaces").alias("other")), "IMPLEMENTS", class_id(F.col("fqn")), class_id(F.col("other")), 1.0))
    )
    none = F.lit(None).cast("long").alias("community_id")
    nodes = types.select(class_id(F.col("fqn")).alias("id"), "kind", "fqn", "simple_name", F.lit(False).alias("external"), none, "status").union(
        m.select(method_id(F.col("fqn"), F.col("signature")).alias("id"), F.lit("METHOD"), F.concat("fqn", F.lit("#"), "signature"), "name", F.lit(False), none, F.lit("PENDING"))
    )
    if rules is not None:
        hits = L.rule_hits(types, rules)
        edges = edges.union(_edges(hits, "USES", class_id(F.col("fqn")), tech_id(F.col("id")), 1.0))
        nodes = nodes.union(hits.select("id", "name").distinct().select(tech_id(F.col("id")), F.lit("TECHNOLOGY"), F.col("id"), F.col("name"), F.lit(False), none, F.lit("PENDING")))
    graph = Graph(nodes, edges, m, types)
    return graph.with_(nodes=graph.nodes.union(M.external_stubs(graph))) if stubs else graph


def deepen(graph: Graph, threshold: float = 0.8) -> Graph:
    """Similarity edges: by vectors of method bodies, or by kind and number of methods where there are under two."""
    vectors = V.embed(graph.methods).where("kind = 'CLASS'").select("fqn", "vector")
    if vectors.limit(2).count() == 2:
        return M.add_edges(graph, V.similarity_edges(V.similar_pairs(vectors, threshold)))
    shapes = V.alike_shapes(graph.types.select("fqn", "kind", F.size("methods").alias("method_count")))
    return M.add_edges(graph, V.similarity_edges(shapes.select("a", "b", F.lit(0.5).alias("score"))).withColumn("confidence_score", F.lit(0.65)))


def build(spark: SparkSession, root: str, options: BuildOptions = BuildOptions(), rules: DataFrame | None = None) -> Graph:
    """Scan, parse, link, tag, deepen and cluster a code base."""
    files = S.scan_sources(spark, root)
    types = pinned(extract_types(files, options.backend), "types")
    graph = graph_of(types, rules if rules is not None else S.load_rules(spark))
    if options.deep:
        graph = deepen(graph)
    return C.cluster(graph, options.clustering) if options.cluster else graph


def incremental_types(old_types: DataFrame, old_manifest: DataFrame, files: DataFrame, profile: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(types, manifest) after parsing only added and changed files and dropping types of changed and deleted ones."""
    manifest = files.select("path", "sha256")
    diff = pinned(D.manifest_diff(old_manifest, manifest), "manifest-diff")
    fresh = extract_types(files.join(D.files_to_parse(diff), "path", "left_semi"), profile)
    stale = diff.where(F.col("state").isin("changed", "deleted")).select(F.col("path").alias("file_path"))
    return pinned(old_types.join(stale, "file_path", "left_anti").select(*fresh.columns).union(fresh), "types"), manifest


def relink(old: Graph, new_types: DataFrame, stale: DataFrame, rules: DataFrame | None = None) -> Graph:
    """The graph of ``new_types``, from ``old`` and what the types in changed, added and deleted files touch.

    ``stale`` (file_path) names those files. Touched are the types that they hold or held: their nodes, methods and
    the edges that start at them are made anew. An edge of an untouched type changes only where the name that
    it points to became a known type or ceased to be one: imports of new names are looked up, and edges to names
    that are gone are dropped. Stubs come and go with the ends that need them. All else is taken over.
    """
    touched = pinned(old.types.join(stale, "file_path", "left_semi").select("fqn").union(new_types.join(stale, "file_path", "left_semi").select("fqn")).distinct(), "touched")
    were, are = old.types.select("fqn").distinct(), new_types.select("fqn").distinct()
    names = touched.join(were.withColumn("_was", F.lit(True)), "fqn", "left").join(are.withColumn("_is", F.lit(True)), "fqn", "left")
    appeared = names.where("_was IS NULL AND _is").select(F.col("fqn").alias("other"))
    vanished = names.where("_was AND _is IS NULL").select(class_id(F.col("fqn")).alias("to_id"))
    fresh_types = pinned(new_types.join(touched, "fqn", "left_semi").select(*new_types.columns), "fresh-types")
    fresh = graph_of(fresh_types, rules, known=are, stubs=False)
    owner = F.coalesce(endpoint_class(F.col("from_id")), F.col("from_id"))
    kept = old.edges.withColumn("_owner", owner).join(touched.select(F.col("fqn").alias("_owner")), "_owner", "left_anti").select(*old.edges.columns)
    changed = touched.select(class_id(F.col("fqn")).alias("to_id"))  # what a type is like depends on both ends
    dropped = kept.where("type = 'DEPENDS_ON'").join(vanished, "to_id", "left_semi").unionByName(kept.where("type = 'SEMANTICALLY_SIMILAR'").join(changed, "to_id", "left_semi")).select(*M.EDGE_KEY)
    untouched = new_types.join(touched, "fqn", "left_anti")
    linked = _edges(_imports(untouched).join(appeared, "other", "left_semi"), "DEPENDS_ON", class_id(F.col("fqn")), class_id(F.col("other")), 3.0)
    edges = kept.join(dropped, M.EDGE_KEY, "left_anti").select(*old.edges.columns).unionByName(fresh.edges).unionByName(linked)
    # Nodes: those of touched types and all stubs go; technologies stay while an edge needs them.
    of = F.when(F.col("id").startswith("method:"), class_fqn_from_method_id(F.col("id"))).otherwise(F.col("fqn"))
    stay = old.nodes.where(~F.col("external")).withColumn("_owner", of).join(touched.select(F.col("fqn").alias("_owner")), "_owner", "left_anti").select(*old.nodes.columns)
    nodes = stay.unionByName(fresh.nodes.select(*old.nodes.columns)).dropDuplicates(["id"])
    used = edges.where("type = 'USES'").select(F.col("to_id").alias("id")).distinct()
    nodes = nodes.where(~F.col("id").startswith("tech:")).unionByName(nodes.where(F.col("id").startswith("tech:")).join(used, "id", "left_semi").select(*nodes.columns))
    methods = old.methods.join(touched, "fqn", "left_anti").select(*old.methods.columns).unionByName(fresh.methods.select(*old.methods.columns))
    graph = Graph(pinned(nodes, "relinked-nodes"), pinned(edges, "relinked-edges"), methods, new_types)
    return graph.with_(nodes=graph.nodes.unionByName(M.external_stubs(graph).select(*nodes.columns)))


def summary(graph: Graph) -> DataFrame:
    return A.build_summary(graph.types)
