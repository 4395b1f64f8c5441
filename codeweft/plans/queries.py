"""Queries over the driver's tables, one for each operator of the inventory, and their DuckDB SQL.

Names start with the operator's id. Where no SQL is given, tests hold the operator against plain results on small graphs; snk18 is only known to have rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..changelog import GraphLog
from ..functions import scalars as S
from ..graph import Graph
from ..operators import analysis as A
from ..operators import community as C
from ..operators import context as X
from ..operators import exports as E
from ..operators import lookups as L
from ..operators import mutate as M
from ..operators import records as R
from ..operators import setops as D
from ..operators import traverse as T
from ..operators import vectors as V
from ..schemas import COMMUNITY_WEIGHTS, RULES
from ..storage import pinned, shared_dir
from ..streaming.events import MIGRATED, SIGNATURE, SPLIT, drain, mutate_log
from .commerce import GRAPH_SQL, commerce, parties, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, graph: bool = True):
    """Register a query; with ``graph`` its SQL starts from the graph's common table expressions."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = (GRAPH_SQL + ", " + sql.strip()[5:] if sql.strip().startswith("WITH ") else GRAPH_SQL + sql) if graph else sql
        return f

    return add


def _one(spark: SparkSession, schema: str, *rows) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


# ---- hubs first: the flagship query


@query("top1_hubs", """
WITH b AS (SELECT a, b FROM class_links UNION SELECT b, a FROM class_links),
d AS (SELECT b.a AS fqn, count(*) AS degree FROM b JOIN classes x ON x.fqn = b.a JOIN classes y ON y.fqn = b.b GROUP BY 1)
SELECT c.fqn, CAST(coalesce(degree, 0) AS BIGINT) AS degree, c.simple_name AS label FROM classes c LEFT JOIN d ON c.fqn = d.fqn ORDER BY degree DESC NULLS LAST, c.fqn LIMIT 10""")
def top1(spark, sf):
    return A.hubs(commerce(spark, sf))


# ---- scans


@query("src11_internal_types", "SELECT fqn, simple_name, kind, community_id FROM classes")
def src11(spark, sf):
    return commerce(spark, sf).classes().select("fqn", "simple_name", "kind", "community_id")


@query("src12_sorted_fqns", "SELECT fqn FROM classes ORDER BY fqn")
def src12(spark, sf):
    return commerce(spark, sf).class_fqns()


@query("src13_class_edges", "SELECT type, from_id, to_id, weight FROM edges WHERE starts_with(from_id, 'class:') AND starts_with(to_id, 'class:')")
def src13(spark, sf):
    return commerce(spark, sf).class_edges().select("type", "from_id", "to_id", "weight")


@query("src14_embeddings", "SELECT 'method:label_' || CAST(label AS VARCHAR) || '#' || CAST(vec_id AS VARCHAR) AS node_id, 'METHOD' AS kind, CAST(len(embedding) AS INTEGER) AS width FROM embeddings WHERE len(embedding) > 0", graph=False)
def src14(spark, sf):
    e = table(spark, sf, "embeddings").where(F.size("embedding") > 0)
    node = S.method_id(F.concat(F.lit("label_"), F.col("label").cast("string")), F.col("vec_id").cast("string"))
    return e.select(node.alias("node_id"), F.when(node.startswith("class:"), "CLASS").otherwise("METHOD").alias("kind"), F.size("embedding").alias("width"))


@query("src15_conversations_as_qa", "SELECT conv_id AS id, question, answer FROM (SELECT conv_id, turn, text AS question, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer FROM conversations) WHERE turn = (SELECT min(turn) FROM conversations) ORDER BY id", graph=False)
def src15(spark, sf):
    c = table(spark, sf, "conversations")
    first = c.agg(F.min("turn")).first()[0]
    w = Window.partitionBy("conv_id").orderBy("turn")
    return c.select("conv_id", "turn", F.col("text").alias("question"), F.lead("text").over(w).alias("answer")).where(F.col("turn") == first).select(F.col("conv_id").alias("id"), "question", "answer").orderBy("id")


# ---- lookups, projections, predicates


@query("prj1_find_type", "SELECT id, kind, fqn, external, community_id, status FROM nodes WHERE id IN (SELECT 'class:' || min(fqn) FROM sides)")
def prj1(spark, sf):
    g = commerce(spark, sf)
    first = parties(spark, sf).agg(F.concat(F.lit("class:"), F.min("fqn")).alias("id"))
    return g.nodes.join(first, "id", "left_semi").select("id", "kind", "fqn", "external", "community_id", "status")


@query("prj2_exists", "SELECT q.id, n.id IS NOT NULL AS found FROM (SELECT 'class:' || fqn || CASE WHEN key % 2 = 0 THEN '' ELSE '?' END AS id FROM sides) q LEFT JOIN nodes n ON n.id = q.id")
def prj2(spark, sf):
    asked = parties(spark, sf).select(F.concat(F.lit("class:"), "fqn", F.when(F.col("key") % 2 == 0, "").otherwise("?")).alias("id"))
    return L.exists(commerce(spark, sf).nodes, asked)


@query("prj3_attributes", "SELECT s.fqn, n.status, n.community_id, n.kind FROM sides s LEFT JOIN nodes n ON n.id = 'class:' || s.fqn WHERE s.side = 's'")
def prj3(spark, sf):
    return L.attributes(commerce(spark, sf), parties(spark, sf).where("side = 's'").select("fqn"), ["status", "community_id", "kind"])


@query("prj4_members", "SELECT fqn FROM nodes WHERE starts_with(id, 'class:') AND community_id = 3 ORDER BY fqn")
def prj4(spark, sf):
    return L.community_members(commerce(spark, sf), 3)


@query("prj5_cluster_json", """WITH m AS (SELECT fqn, '"' || string_agg(signature, '","' ORDER BY signature) || '"' AS signatures FROM methods GROUP BY 1)
SELECT community_id, '[' || string_agg('{"fqn":"' || n.fqn || '","simpleName":"' || simple_name || '","kind":"' || kind || '","status":"' || status || '","methods":[' || coalesce(signatures, '') || ']}', ',' ORDER BY n.fqn) || ']' AS json
FROM nodes n LEFT JOIN m ON m.fqn = n.fqn WHERE starts_with(id, 'class:') AND community_id IS NOT NULL GROUP BY 1""")
def prj5(spark, sf):
    return L.cluster_json(commerce(spark, sf)).select("community_id", "json")


@query("prj6_method_context", """
WITH asked AS (SELECT DISTINCT fqn, '1-URGENT' AS wanted FROM methods),
hits AS (SELECT a.fqn, wanted, name, signature, return_type, row_number() OVER (PARTITION BY a.fqn, wanted ORDER BY CASE WHEN signature <> wanted THEN 1 ELSE 0 END, signature) AS r FROM asked a JOIN methods m ON a.fqn = m.fqn AND (signature = wanted OR name = wanted))
SELECT h.fqn, wanted, name, signature, return_type, s.simple_name, s.kind, 'PENDING' AS status FROM hits h JOIN sides s ON h.fqn = s.fqn WHERE r = 1""")
def prj6(spark, sf):
    g = commerce(spark, sf)
    return L.method_context(g, g.methods.select("fqn").distinct().withColumn("wanted", F.lit("1-URGENT"))).select("fqn", "wanted", "name", "signature", "return_type", "simple_name", "kind", "status")


@query("prj7_call_signatures", """
WITH asked AS (SELECT DISTINCT fqn FROM methods), calls AS (SELECT fqn, 0 AS pos, '1-URGENT' AS name FROM asked UNION ALL SELECT fqn, 1, '5-LOW' FROM asked)
SELECT c.fqn, CAST(pos AS INTEGER) AS pos, c.name, m.signature FROM calls c JOIN methods m ON c.fqn = m.fqn AND c.name = m.name""")
def prj7(spark, sf):
    g = commerce(spark, sf)
    asked = g.methods.select("fqn").distinct().withColumn("calls", F.array(F.lit("1-URGENT"), F.lit("5-LOW")))
    return L.call_signatures(g, asked)


@query("prj8_resolve_names", """
WITH q AS (SELECT simple_name AS q FROM sides WHERE side = 's' UNION SELECT fqn FROM sides WHERE side = 's' UNION SELECT 'nothing of this name')
SELECT q.q, min(c.fqn) AS fqn FROM q LEFT JOIN classes c ON c.fqn = q.q OR ends_with(c.fqn, '.' || q.q) GROUP BY 1""")
def prj8(spark, sf):
    s = parties(spark, sf).where("side = 's'")
    asked = s.select(F.col("simple_name").alias("q")).union(s.select("fqn")).union(_one(spark, "q string", ("nothing of this name",))).distinct()
    return L.resolve_names(commerce(spark, sf), asked)


@query("prj9_seeds", """
SELECT doc_id AS question_id, name, CAST(r AS INTEGER) AS rank FROM (
  SELECT doc_id, b.text AS name, row_number() OVER (PARTITION BY doc_id ORDER BY b.text) AS r FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text))) WHERE r <= 3""", graph=False)
def prj9(spark, sf):
    questions = table(spark, sf, "documents").select(F.col("doc_id").alias("question_id"), F.col("text").alias("question"))
    return L.seeds_by_name(table(spark, sf, "benchmark").select(F.col("text").alias("name")), questions)


@query("prj10_deprecated", "SELECT url AS file_path, 'http://' AS prefix, page_id FROM pages WHERE starts_with(url, 'http://')", graph=False)
def prj10(spark, sf):
    types = table(spark, sf, "pages").select(F.col("url").alias("file_path"), F.array("url").alias("imports"), F.col("page_id").alias("fqn"))
    return L.deprecated_imports(types, "http://").select("file_path", F.lit("http://").alias("prefix"), F.col("fqn").alias("page_id"))


@query("prj15_whitelist", "SELECT type, split_part(regexp_replace(from_id, '^(class|method):', ''), '#', 1) AS a, split_part(regexp_replace(to_id, '^(class|method):', ''), '#', 1) AS b, weight FROM edges WHERE type IN ('DEPENDS_ON', 'CALLS', 'EXTENDS', 'IMPLEMENTS')")
def prj15(spark, sf):
    return L.whitelisted(commerce(spark, sf).edges, COMMUNITY_WEIGHTS)


# ---- joins


def _hits(spark, sf) -> DataFrame:
    """Types by the brands that they use: (fqn, id, name, category)."""
    g = commerce(spark, sf)
    uses = g.edges.where("type = 'USES'").select(F.substr("from_id", F.lit(7)).alias("fqn"), F.substr("to_id", F.lit(6)).alias("id"))
    return uses.join(g.classes().select("fqn"), "fqn", "left_semi").select("fqn", "id", F.col("id").alias("name"), F.substring("id", 1, 7).alias("category"))


HITS = "WITH hits AS (SELECT u.fqn, p_brand AS id, substr(p_brand, 1, 7) AS category FROM used u JOIN classes c ON u.fqn = c.fqn) "


@query("joi1_categories", HITS + "SELECT fqn, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM hits GROUP BY 1")
def joi1(spark, sf):
    return _hits(spark, sf).groupBy("fqn").agg(F.array_join(F.sort_array(F.collect_set("category")), ",").alias("categories"))


@query("joi2_calls", "SELECT from_id, to_id, weight FROM edges WHERE type = 'CALLS'")
def joi2(spark, sf):
    return commerce(spark, sf).edges.where("type = 'CALLS'").select("from_id", "to_id", "weight")


@query("joi3_known_imports", "SELECT DISTINCT a, b FROM class_links WHERE type = 'DEPENDS_ON' AND b IN (SELECT fqn FROM classes)")
def joi3(spark, sf):
    g = commerce(spark, sf)
    return g.class_links().where("type = 'DEPENDS_ON'").select("a", "b").distinct().join(g.classes().select(F.col("fqn").alias("b")), "b", "left_semi").select("a", "b")


@query("joi4_external_stubs", "SELECT to_id AS id, min(CASE WHEN type = 'IMPLEMENTS' THEN 'INTERFACE' ELSE 'CLASS' END) AS kind FROM edges WHERE type IN ('EXTENDS', 'IMPLEMENTS') GROUP BY 1")
def joi4(spark, sf):
    g = commerce(spark, sf)
    return M.external_stubs(g.with_(nodes=g.nodes.where("status <> 'EXTERNAL'"))).select("id", "kind")


def _vectors(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.lpad(F.col("vec_id").cast("string"), 8, "0").alias("fqn"), F.col("embedding").alias("vector"), "label")


PAIRS = """WITH v AS (SELECT lpad(CAST(vec_id AS VARCHAR), 8, '0') AS fqn, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings),
p AS (SELECT a.fqn AS a, b.fqn AS b, list_cosine_similarity(a.x, b.x) AS s FROM v a JOIN v b ON a.fqn < b.fqn)
"""


@query("joi5_similar_pairs", PAIRS + "SELECT a, b, round(s, 4) AS score FROM p WHERE s >= 0.35", graph=False)
def joi5(spark, sf):
    return V.similar_pairs(_vectors(spark, sf), 0.35).select("a", "b", F.round("score", 4).alias("score"))


@query("joi6_alike_shapes", "SELECT x.fqn AS a, y.fqn AS b, CAST(0.5 AS DOUBLE) AS weight, CAST(0.65 AS DOUBLE) AS confidence_score FROM sides x JOIN sides y ON x.side = 's' AND y.side = 's' AND x.community_id = y.community_id AND x.fqn < y.fqn")
def joi6(spark, sf):
    t = parties(spark, sf).where("side = 's'").select("fqn", "kind", F.col("community_id").alias("method_count"))
    return V.alike_shapes(t)


@query("joi8_adjacency", "SELECT fqn, type, other FROM near")
def joi8(spark, sf):
    return commerce(spark, sf).neighbours(("DEPENDS_ON", "CALLS", "EXTENDS", "IMPLEMENTS", "USES", "SEMANTICALLY_SIMILAR"))


@query("joi9_edge_communities", "SELECT l.type, l.a, l.b, x.community_id AS community_a, y.community_id AS community_b FROM class_links l LEFT JOIN classes x ON x.fqn = l.a LEFT JOIN classes y ON y.fqn = l.b")
def joi9(spark, sf):
    g = commerce(spark, sf)
    return A.linked(g).select("type", "a", "b", "community_a", "community_b")


# ---- aggregations


@query("agg1_node_counts", "SELECT count(*) FILTER (starts_with(id, 'class:') AND NOT external) AS types, count(*) FILTER (starts_with(id, 'class:') AND external) AS external, count(*) FILTER (starts_with(id, 'method:')) AS methods, count(*) FILTER (starts_with(id, 'tech:')) AS technologies FROM nodes")
def agg1(spark, sf):
    return A.node_counts(commerce(spark, sf))


@query("agg2_edge_counts", "SELECT type, count(*) AS edges FROM edges GROUP BY 1")
def agg2(spark, sf):
    return A.edge_counts(commerce(spark, sf))


@query("agg3_communities", "SELECT count(DISTINCT community_id) AS communities FROM nodes WHERE starts_with(id, 'class:')")
def agg3(spark, sf):
    return A.community_count(commerce(spark, sf))


@query("agg4_stats", """
SELECT (SELECT count(*) FROM classes) AS types, (SELECT count(*) FROM nodes WHERE starts_with(id, 'class:') AND external) AS external, (SELECT count(*) FROM methods) AS methods, (SELECT count(*) FROM nodes WHERE starts_with(id, 'tech:')) AS technologies,
  (SELECT count(DISTINCT community_id) FROM nodes WHERE starts_with(id, 'class:')) AS communities, e.* FROM (SELECT count(*) FILTER (type = 'CONTAINS') AS contains_edges, count(*) FILTER (type = 'CALLS') AS calls_edges, count(*) FILTER (type = 'EXTENDS') AS extends_edges, count(*) FILTER (type = 'IMPLEMENTS') AS implements_edges,
  count(*) FILTER (type = 'DEPENDS_ON') AS depends_on_edges, count(*) FILTER (type = 'USES') AS uses_edges, count(*) FILTER (type = 'SEMANTICALLY_SIMILAR') AS semantically_similar_edges FROM edges) e""")
def agg4(spark, sf):
    return A.graph_stats(commerce(spark, sf))


@query("agg5_technology_uses", "SELECT to_id AS tech, count(*) AS uses FROM edges WHERE type = 'USES' GROUP BY 1")
def agg5(spark, sf):
    return A.technology_uses(commerce(spark, sf))


@query("agg6_build_summary", """SELECT (SELECT count(*) FROM sides) AS types, (SELECT count(*) FROM sides WHERE kind = 'CLASS') AS class, (SELECT count(*) FROM sides WHERE kind = 'INTERFACE') AS interface, CAST(0 AS BIGINT) AS enum, CAST(0 AS BIGINT) AS record, CAST(0 AS BIGINT) AS annotation,
  (SELECT count(*) FROM methods) AS methods, (SELECT count(*) FROM sides) AS fields, (SELECT count(*) FROM bought) AS imports, CAST(0 AS BIGINT) AS annotations, CAST(0 AS BIGINT) AS enum_constants, CAST(0 AS BIGINT) AS record_components, (SELECT count(*) FROM methods WHERE return_type = 'F') AS constructors""")
def agg6(spark, sf):
    """Types with their orders as methods (finished ones as constructors), a field each, and what they buy from as imports."""
    g = commerce(spark, sf)
    methods = g.methods.groupBy("fqn").agg(F.collect_list(F.struct("signature", (F.col("return_type") == "F").alias("constructor"))).alias("methods"))
    imports = g.class_links().where("type = 'DEPENDS_ON'").groupBy(F.col("a").alias("fqn")).agg(F.collect_set("b").alias("imports"))
    none = F.array().cast("array<string>")
    rows = parties(spark, sf).select("fqn", "kind", F.array("simple_name").alias("fields")).join(methods, "fqn", "left").join(imports, "fqn", "left")
    filled = rows.withColumns({"methods": F.coalesce("methods", F.array().cast("array<struct<signature:string,constructor:boolean>>")), "imports": F.coalesce("imports", none), "annotations": none, "enum_constants": none, "record_components": none})
    return A.build_summary(filled).select(*[F.col(c).cast("long").alias(c) for c in ("types", "class", "interface", "enum", "record", "annotation", "methods", "fields", "imports", "annotations", "enum_constants", "record_components", "constructors")])


@query("agg8_degrees", """
WITH b AS (SELECT a, b FROM class_links UNION SELECT b, a FROM class_links),
d AS (SELECT b.a AS fqn, count(*) AS degree FROM b JOIN classes x ON x.fqn = b.a JOIN classes y ON y.fqn = b.b GROUP BY 1)
SELECT c.fqn, CAST(coalesce(degree, 0) AS BIGINT) AS degree FROM classes c LEFT JOIN d ON c.fqn = d.fqn""")
def agg8(spark, sf):
    return A.degrees(commerce(spark, sf))


WEIGHTS = """WITH w AS (SELECT type, split_part(regexp_replace(from_id, '^(class|method):', ''), '#', 1) AS a, split_part(regexp_replace(to_id, '^(class|method):', ''), '#', 1) AS b FROM edges WHERE type IN ('DEPENDS_ON', 'CALLS', 'EXTENDS', 'IMPLEMENTS')),
pw AS (SELECT least(a, b) AS a, greatest(a, b) AS b, CAST(sum(CASE type WHEN 'DEPENDS_ON' THEN 3 WHEN 'CALLS' THEN 2 ELSE 1 END) AS DOUBLE) AS weight FROM w WHERE a <> b GROUP BY 1, 2)"""


@query("agg9_pair_weights", WEIGHTS + " SELECT a, b, weight FROM pw")
def agg9(spark, sf):
    return A.pair_weights(commerce(spark, sf))


@query("agg10_cohesion", """
WITH s AS (SELECT community_id, count(*) AS members FROM classes WHERE community_id IS NOT NULL GROUP BY 1),
i AS (SELECT x.community_id, count(*) AS n FROM class_links l JOIN classes x ON x.fqn = l.a JOIN classes y ON y.fqn = l.b AND x.community_id = y.community_id GROUP BY 1)
SELECT s.community_id, members, CASE WHEN members < 2 THEN 1.0 ELSE least(1.0, coalesce(n, 0) / (members * (members - 1) / 2.0)) END AS cohesion FROM s LEFT JOIN i USING (community_id)""")
def agg10(spark, sf):
    return A.cohesion(commerce(spark, sf))


LABELS = """WITH t AS (SELECT community_id, split_part(fqn, '.', 2) AS top, count(*) AS n FROM classes WHERE community_id IS NOT NULL GROUP BY 1, 2),
lab AS (SELECT community_id, arg_min(top, (-n, top)) || ' (' || CAST(CAST(sum(n) AS BIGINT) AS VARCHAR) || ' types)' AS label FROM t GROUP BY 1)"""


@query("agg11_labels", LABELS + " SELECT community_id, label FROM lab")
def agg11(spark, sf):
    return A.labels(commerce(spark, sf))


@query("agg12_insights", LABELS + " SELECT c.community_id, label, string_agg(fqn, ',' ORDER BY fqn) AS members FROM classes c JOIN lab ON lab.community_id = c.community_id GROUP BY 1, 2")
def agg12(spark, sf):
    return A.insights(commerce(spark, sf)).select("community_id", "label", F.array_join("types", ",").alias("members"))


@query("agg13_summaries", """
WITH r AS (SELECT community_id, fqn, row_number() OVER (PARTITION BY community_id ORDER BY fqn) AS r FROM classes WHERE community_id IS NOT NULL),
t AS (SELECT community_id, 'Community ' || CAST(community_id AS VARCHAR) || ' contains ' || CAST(count(*) AS VARCHAR) || ' types: ' || string_agg(fqn, ', ' ORDER BY fqn) FILTER (r <= 5) AS summary FROM r GROUP BY 1)
SELECT community_id, summary, CAST(greatest(1, length(summary) // 4) AS BIGINT) AS tokens FROM t""")
def agg13(spark, sf):
    return A.summaries(commerce(spark, sf))


@query("agg14_bill", HITS + ", r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY fqn) AS r FROM hits) SELECT id, category, count(*) AS uses, string_agg(fqn, ',' ORDER BY fqn) FILTER (r <= 5) AS examples FROM r GROUP BY 1, 2")
def agg14(spark, sf):
    return A.bill_of_technologies(_hits(spark, sf)).select("id", "category", "uses", F.array_join("examples", ",").alias("examples"))


@query("agg14_categories", HITS + "SELECT category, count(*) AS uses FROM hits GROUP BY 1")
def agg14c(spark, sf):
    return A.category_totals(_hits(spark, sf))


@query("agg15_hyperedges", HITS + "SELECT 'tech-' || replace(lower(category), ' ', '-') AS id, category || ' users' AS label, string_agg(DISTINCT fqn, ',' ORDER BY fqn) AS members, CAST(0.85 AS DOUBLE) AS confidence_score FROM hits GROUP BY category HAVING count(DISTINCT fqn) >= 3")
def agg15(spark, sf):
    return A.technology_hyperedges(_hits(spark, sf)).select("id", "label", F.array_join("node_ids", ",").alias("members"), "confidence_score")


VECTOR_SQL = "WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS x FROM embeddings ORDER BY vec_id LIMIT 1), s AS (SELECT label, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), q.x) AS s FROM embeddings e, q) "


def _first_vector(spark, sf) -> list[float]:
    return table(spark, sf, "embeddings").orderBy("vec_id").select("embedding").first()[0]


@query("agg16_best_of_class", VECTOR_SQL + "SELECT CAST(label AS VARCHAR) AS fqn, round(max(s), 4) AS score FROM s GROUP BY 1", graph=False)
def agg16(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("label").cast("string").alias("fqn"), F.col("embedding").alias("vector"))
    return V.best_scores(v, _first_vector(spark, sf), -1.0).select("fqn", F.round("score", 4).alias("score"))


@query("agg18_compare_backends", "SELECT (SELECT count(*) FROM sides) AS left_types, (SELECT count(*) FROM classes) AS right_types, (SELECT count(*) FROM sides WHERE external) AS only_left")
def agg18(spark, sf):
    all_, inside = parties(spark, sf).select("fqn"), commerce(spark, sf).classes().select("fqn")
    n = F.count(F.lit(1))
    return all_.agg(n.alias("left_types")).join(inside.agg(n.alias("right_types"))).join(all_.exceptAll(inside).agg(n.alias("only_left")))


# ---- top-k


@query("top2_surprising", """
WITH s AS (SELECT l.a, l.b, l.type, round(CASE WHEN x.community_id <> y.community_id THEN 0.5 ELSE 0 END + CASE WHEN l.type IN ('DEPENDS_ON', 'IMPLEMENTS') THEN 0.2 ELSE 0 END, 6) AS score FROM class_links l LEFT JOIN classes x ON x.fqn = l.a LEFT JOIN classes y ON y.fqn = l.b)
SELECT a, b, type, CAST(score AS DOUBLE) AS score FROM s WHERE score >= 0.5 ORDER BY score DESC, a, b, type LIMIT 10""")
def top2(spark, sf):
    return A.surprising(commerce(spark, sf))


@query("top3_strongest_pairs", PAIRS + "SELECT a, b, round(s, 4) AS score FROM p WHERE s >= 0.35 ORDER BY s DESC, a, b LIMIT 50", graph=False)
def top3(spark, sf):
    return V.strongest(V.similar_pairs(_vectors(spark, sf), 0.35)).select("a", "b", F.round("score", 4).alias("score"))


@query("top4_vector_search", VECTOR_SQL + "SELECT CAST(label AS VARCHAR) AS fqn, round(max(s), 4) AS score FROM s WHERE s >= 0.1 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5", graph=False)
def top4(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("label").cast("string").alias("fqn"), F.col("embedding").alias("vector"))
    return V.search(v, _first_vector(spark, sf), 5, 0.1).select("fqn", F.round("score", 4).alias("score"))


@query("top5_budget_prefix", "SELECT conv_id, turn, CAST(running AS BIGINT) AS running FROM (SELECT conv_id, turn, sum(CASE WHEN trim(text) = '' THEN 0 ELSE greatest(1, length(text) // 4) END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS running FROM conversations) WHERE running <= 60", graph=False)
def top5(spark, sf):
    c = table(spark, sf, "conversations").withColumn("tokens", S.token_estimate(F.col("text")))
    return X.budget_prefix(c, ["conv_id"], ["turn"], "tokens", F.lit(60)).select("conv_id", "turn", "running")


@query("top6_questions", """WITH b AS (SELECT a, b FROM class_links UNION SELECT b, a FROM class_links),
d AS (SELECT b.a AS fqn, count(*) AS degree FROM b JOIN classes x ON x.fqn = b.a JOIN classes y ON y.fqn = b.b GROUP BY 1),
hub AS (SELECT split_part(c.fqn, '.', -1) AS label FROM classes c LEFT JOIN d ON d.fqn = c.fqn ORDER BY coalesce(degree, 0) DESC, c.fqn LIMIT 1),
odd AS (SELECT l.a, l.b FROM class_links l LEFT JOIN classes x ON x.fqn = l.a LEFT JOIN classes y ON y.fqn = l.b WHERE x.community_id <> y.community_id ORDER BY CASE WHEN l.type IN ('DEPENDS_ON', 'IMPLEMENTS') THEN 0 ELSE 1 END, l.a, l.b, l.type LIMIT 1)
SELECT CAST(1 AS INTEGER) AS rank, 'What depends on ' || label || ' and why is it a hub?' AS question FROM hub UNION ALL SELECT 2, 'Why does ' || split_part(a, '.', -1) || ' connect to ' || split_part(b, '.', -1) || ' across communities?' FROM odd
UNION ALL SELECT 3, 'Which types bridge the ' || CAST(n AS VARCHAR) || ' detected communities?' FROM (SELECT count(DISTINCT community_id) AS n FROM nodes WHERE starts_with(id, 'class:')) WHERE n > 1
UNION ALL SELECT 4, 'What are the strongest DEPENDS_ON chains in this codebase?' UNION ALL SELECT 5, 'Which interfaces are implemented by multiple unrelated classes?'""")
def top6(spark, sf):
    return A.suggested_questions(commerce(spark, sf))


# ---- sets, diffs, manifests


def _before(g):
    """The graph as it was: without the types of community 3."""
    gone = g.nodes.where("id LIKE 'class:%' AND community_id = 3").select("id")
    return M.delete_nodes(g, gone)


BEFORE = "WITH gone AS (SELECT id FROM nodes WHERE starts_with(id, 'class:') AND community_id = 3), old_edges AS (SELECT * FROM edges WHERE from_id NOT IN (SELECT id FROM gone) AND to_id NOT IN (SELECT id FROM gone)), old_classes AS (SELECT * FROM classes WHERE id NOT IN (SELECT id FROM gone)) "


@query("set1_snapshot", "SELECT (SELECT count(*) FROM classes) AS type_count, (SELECT count(*) FROM edges) AS edge_count")
def set1(spark, sf):
    return D.snapshot(commerce(spark, sf))


@query("set2_diff_types", BEFORE + "SELECT fqn, 'added' AS change FROM classes WHERE fqn NOT IN (SELECT fqn FROM old_classes)")
def set2(spark, sf):
    g = commerce(spark, sf)
    return D.type_changes(_before(g), g)


@query("set2_diff_counts", BEFORE + ", n AS (SELECT (SELECT count(*) FROM classes) - (SELECT count(*) FROM old_classes) AS t, (SELECT count(*) FROM edges) - (SELECT count(*) FROM old_edges) AS e) SELECT t AS added_types, CAST(0 AS BIGINT) AS removed_types, greatest(0, e) AS added_edges, greatest(0, t - e) AS removed_edges FROM n")
def set2c(spark, sf):
    g = commerce(spark, sf)
    return D.diff_summary(_before(g), g)


@query("set2_diff_edges", BEFORE + "SELECT type, count(*) AS added FROM edges WHERE from_id IN (SELECT id FROM gone) OR to_id IN (SELECT id FROM gone) GROUP BY 1")
def set2e(spark, sf):
    g = commerce(spark, sf)
    return D.edge_changes(_before(g), g).where("change = 'added'").groupBy("type").agg(F.count(F.lit(1)).alias("added"))


def _manifests(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), "doc_id", "text")
    old = d.where("doc_id % 7 <> 1").select("path", F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha256"))
    return old, d.where("doc_id % 11 <> 2").select("path", F.sha2("text", 256).alias("sha256"))


MANIFESTS = """WITH o AS (SELECT CAST(doc_id AS VARCHAR) AS path, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 7 <> 1),
n AS (SELECT CAST(doc_id AS VARCHAR) AS path, sha256(text) AS h FROM documents WHERE doc_id % 11 <> 2),
m AS (SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'deleted' WHEN o.h <> n.h THEN 'changed' ELSE 'unchanged' END AS state FROM o FULL JOIN n ON o.path = n.path) """


@query("set3_manifest_diff", MANIFESTS + "SELECT path, state FROM m", graph=False)
def set3(spark, sf):
    return D.manifest_diff(*_manifests(spark, sf))


@query("set4_files_to_parse", MANIFESTS + "SELECT path FROM m WHERE state IN ('added', 'changed')", graph=False)
def set4(spark, sf):
    return D.files_to_parse(D.manifest_diff(*_manifests(spark, sf)))


@query("set5_merged_nodes", BEFORE + "SELECT id FROM nodes WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'secondary:' || id FROM nodes WHERE NOT external")
def set5(spark, sf):
    g = commerce(spark, sf)
    return D.merge_graphs(_before(g), g.with_(nodes=g.nodes.where("NOT external"))).nodes.select("id")


@query("set6_merged_edges", "SELECT type, from_id, to_id, weight FROM edges")
def set6(spark, sf):
    g = commerce(spark, sf)
    return D.merge_graphs(_before(g), g.with_(edges=g.edges.withColumn("weight", F.col("weight")))).edges.select("type", "from_id", "to_id", "weight")


# ---- traversals and communities


HOPS = """WITH s AS (SELECT fqn FROM classes WHERE simple_name IN ('Supplier_000000001', 'Supplier_000000003')),
n2 AS (SELECT DISTINCT fqn, other FROM near), h1 AS (SELECT DISTINCT s.fqn AS start, other AS fqn FROM s JOIN n2 ON n2.fqn = s.fqn WHERE other <> s.fqn),
h2 AS (SELECT DISTINCT start, other AS fqn FROM h1 JOIN n2 ON n2.fqn = h1.fqn WHERE other <> start AND (start, other) NOT IN (SELECT (start, fqn) FROM h1)) """


@query("gra1_hops", HOPS + "SELECT start, fqn, 1 AS depth FROM h1 UNION ALL SELECT start, fqn, 2 FROM h2")
def gra1(spark, sf):
    g = commerce(spark, sf)
    starts = g.classes().where(F.col("simple_name").isin("Supplier_000000001", "Supplier_000000003")).select("fqn")
    return T.k_hops(g, starts, 2)


@query("gra2_breadth_first", """
WITH s AS (SELECT fqn, row_number() OVER (ORDER BY fqn) AS r FROM classes WHERE simple_name IN ('Supplier_000000001', 'Supplier_000000003')),
n2 AS (SELECT *, CASE type WHEN 'DEPENDS_ON' THEN 0 WHEN 'CALLS' THEN 1 WHEN 'EXTENDS' THEN 2 WHEN 'IMPLEMENTS' THEN 3 WHEN 'USES' THEN 4 ELSE 5 END AS o FROM near),
b1 AS (SELECT *, row_number() OVER (ORDER BY pr, o, fqn) AS rank FROM (SELECT other AS fqn, s.fqn AS from_fqn, type AS via, s.r AS pr, o, row_number() OVER (PARTITION BY other ORDER BY s.r, o) AS k FROM s JOIN n2 ON n2.fqn = s.fqn WHERE other NOT IN (SELECT fqn FROM s)) WHERE k = 1),
b2 AS (SELECT * FROM (SELECT other AS fqn, b1.fqn AS from_fqn, type AS via, row_number() OVER (PARTITION BY other ORDER BY rank, n2.o) AS k FROM b1 JOIN n2 ON n2.fqn = b1.fqn WHERE other NOT IN (SELECT fqn FROM s) AND other NOT IN (SELECT fqn FROM b1)) WHERE k = 1)
SELECT fqn, 0 AS depth, NULL AS from_fqn, NULL AS via FROM s UNION ALL SELECT fqn, 1, from_fqn, via FROM b1 UNION ALL SELECT fqn, 2, from_fqn, via FROM b2""")
def gra2(spark, sf):
    g = commerce(spark, sf)
    seeds = g.classes().where(F.col("simple_name").isin("Supplier_000000001", "Supplier_000000003")).select("fqn", F.row_number().over(Window.orderBy("fqn")).alias("rank"))
    return T.breadth_first(g, seeds, 2).drop("place")


def _seed(g) -> str:
    return g.classes().where("kind = 'INTERFACE'").agg(F.min("fqn")).first()[0]


@query("gra3_depth_first")
def gra3(spark, sf):
    g = commerce(spark, sf)
    return T.depth_first(g, _seed(g), 3, ("DEPENDS_ON", "EXTENDS"))


@query("gra4_answer", """WITH s AS (SELECT min(fqn) AS fqn FROM classes WHERE kind = 'INTERFACE'), n2 AS (SELECT *, CASE type WHEN 'DEPENDS_ON' THEN 0 WHEN 'CALLS' THEN 1 WHEN 'EXTENDS' THEN 2 WHEN 'IMPLEMENTS' THEN 3 WHEN 'USES' THEN 4 ELSE 5 END AS o FROM near WHERE fqn <> other),
b1 AS (SELECT * FROM (SELECT other AS fqn, s.fqn AS from_fqn, type AS via, o, row_number() OVER (PARTITION BY other ORDER BY o) AS k FROM s JOIN n2 ON n2.fqn = s.fqn) WHERE k = 1),
steps AS (SELECT fqn, 0 AS depth, CAST(NULL AS VARCHAR) AS from_fqn, CAST(NULL AS VARCHAR) AS via, 0 AS o FROM s UNION ALL SELECT fqn, 1, from_fqn, via, o FROM b1),
others AS (SELECT fqn, string_agg('    → ' || other || chr(10), '' ORDER BY other) AS l FROM (SELECT DISTINCT fqn, other FROM n2) GROUP BY 1),
said AS (SELECT depth, o, t.fqn, '- [depth ' || CAST(depth AS VARCHAR) || '] ' || t.fqn || CASE WHEN via IS NULL THEN '' ELSE ' (via ' || via || ' from ' || from_fqn || ')' END || chr(10) || coalesce(l, '') AS line FROM steps t LEFT JOIN others ON others.fqn = t.fqn)
SELECT substr('Query: what depends on it' || chr(10) || chr(10) || string_agg(line, '' ORDER BY depth, o, fqn), 1, 800) AS answer FROM said""")
def gra4(spark, sf):
    g = commerce(spark, sf)
    steps = T.breadth_first(g, _one(spark, "fqn string, rank int", (_seed(g), 1)), 1)
    return T.answer_text(g, steps, "what depends on it", 200)


PATH = """WITH ends AS (SELECT min(fqn) AS a, max(fqn) AS b FROM classes WHERE kind = 'INTERFACE'),
l AS (SELECT a, b FROM class_links UNION SELECT b, a FROM class_links), li AS (SELECT l.a, l.b FROM l JOIN classes x ON x.fqn = l.a JOIN classes y ON y.fqn = l.b),
walk AS (SELECT a AS fqn, 0 AS depth FROM ends UNION SELECT li.b, depth + 1 FROM walk JOIN li ON li.a = walk.fqn WHERE depth < 8) """


@query("gra5_shortest_path", PATH + "SELECT ends.a AS source, ends.b AS target, CAST(coalesce((SELECT min(depth) + 1 FROM walk WHERE fqn = ends.b), 0) AS INTEGER) AS vertices FROM ends")
def gra5(spark, sf):
    g = commerce(spark, sf)
    a, b = g.classes().where("kind = 'INTERFACE'").agg(F.min("fqn"), F.max("fqn")).first()
    return T.shortest_path(g, a, b).select("source", "target", F.size("hops").alias("vertices"))


#: The least of the shortest paths, hop by hop: of the neighbours that are nearer to the target, the least.
ROUTE = """WITH ends AS (SELECT min(fqn) AS a, max(fqn) AS b FROM classes WHERE kind = 'INTERFACE'),
l AS (SELECT a, b FROM class_links UNION SELECT b, a FROM class_links), li AS (SELECT l.a, l.b FROM l JOIN classes x ON x.fqn = l.a JOIN classes y ON y.fqn = l.b WHERE l.a <> l.b),
back AS (SELECT b AS fqn, 0 AS depth FROM ends UNION SELECT li.b, depth + 1 FROM back JOIN li ON li.a = back.fqn WHERE depth < 8), far AS (SELECT fqn, min(depth) AS d FROM back GROUP BY 1),
step AS (SELECT li.a AS fqn, min(li.b) AS other FROM li JOIN far x ON x.fqn = li.a JOIN far y ON y.fqn = li.b AND y.d = x.d - 1 GROUP BY 1),
route AS (SELECT a AS fqn, [a] AS hops FROM ends UNION ALL SELECT other, list_append(hops, other) FROM route JOIN step ON step.fqn = route.fqn) """


@query("gra5_hops", ROUTE + "SELECT a AS source, b AS target, array_to_string((SELECT hops FROM route WHERE route.fqn = ends.b), ',') AS hops FROM ends")
def gra5_hops(spark, sf):
    g = commerce(spark, sf)
    a, b = g.classes().where("kind = 'INTERFACE'").agg(F.min("fqn"), F.max("fqn")).first()
    return T.shortest_path(g, a, b).select("source", "target", F.array_join("hops", ",").alias("hops"))


@query("gra6_explain_path", ROUTE + """SELECT a AS source, b AS target, CASE WHEN a = b THEN 'Start and end are the same type.' ELSE coalesce((SELECT 'Path (' || CAST(len(hops) AS VARCHAR) || ' hops): ' || array_to_string(list_transform(hops, lambda x: split_part(x, '.', -1)), ' → ') || '. Each hop is a structural relationship in the Java graph.' FROM route WHERE route.fqn = ends.b), 'No path found between types.') END AS explanation FROM ends""")
def gra6(spark, sf):
    g = commerce(spark, sf)
    a, b = g.classes().where("kind = 'INTERFACE'").agg(F.min("fqn"), F.max("fqn")).first()
    return T.explain_path(T.shortest_path(g, a, b)).select("source", "target", "explanation")


@query("gra7_explain_types", LABELS + """, o AS (SELECT fqn, count(DISTINCT other) AS n, list_sort(list(DISTINCT other)) AS l FROM near GROUP BY 1)
SELECT c.fqn, simple_name || ' (' || c.fqn || ') in package ' || regexp_replace(c.fqn, '\\.[^.]*$', '') || ' is a ' || lower(kind) || ' with 0 methods. It belongs to ' || label || ' and connects to ' || CAST(coalesce(n, 0) AS VARCHAR) || ' neighbor types: ' ||
  array_to_string(list_transform(l[1:5], lambda x: split_part(x, '.', -1)), ', ') || '.' AS sentence FROM classes c JOIN lab ON lab.community_id = c.community_id LEFT JOIN o ON o.fqn = c.fqn WHERE kind = 'INTERFACE'""")
def gra7(spark, sf):
    g = commerce(spark, sf)
    return T.explain_types(g, g.classes().where("kind = 'INTERFACE'").select("fqn"), A.labels(g))


def _round(i: int) -> str:
    return f"""v{i} AS (SELECT a AS fqn, label, weight FROM li JOIN l{i - 1} ON l{i - 1}.fqn = li.b UNION ALL SELECT fqn, label, 1.0 FROM l{i - 1}),
s{i} AS (SELECT fqn, label, sum(weight) AS w FROM v{i} GROUP BY 1, 2),
l{i} AS (SELECT fqn, label FROM (SELECT *, row_number() OVER (PARTITION BY fqn ORDER BY w DESC, label) AS r FROM s{i}) WHERE r = 1)"""


@query("gra8_label_rounds", WEIGHTS + ", lx AS (SELECT a, b, weight FROM pw UNION ALL SELECT b, a, weight FROM pw), li AS (SELECT lx.a, lx.b, weight FROM lx JOIN classes x ON x.fqn = lx.a JOIN classes y ON y.fqn = lx.b), l0 AS (SELECT fqn, fqn AS label FROM classes), " + ", ".join(_round(i) for i in (1, 2, 3)) + " SELECT fqn, label FROM l3")
def gra8_rounds(spark, sf):
    return C.propagate_rounds(commerce(spark, sf), 3)


@query("gra8_label_propagation")
def gra8(spark, sf):
    return C.label_propagation(commerce(spark, sf))


@query("gra10_assigned", "WITH m AS (SELECT community_id, min(fqn) AS least FROM classes GROUP BY 1), r AS (SELECT community_id, row_number() OVER (ORDER BY least) - 1 AS new_id FROM m) SELECT fqn, new_id AS community_id FROM classes JOIN r ON r.community_id = classes.community_id")
def gra10(spark, sf):
    g = commerce(spark, sf)
    labels = g.classes().select("fqn", F.col("community_id").cast("string").alias("label"))
    return C.assign(g, labels).classes().select("fqn", "community_id")


# ---- scalars


@query("sca1_ids", "SELECT id, split_part(substr(id, 8), '#', 1) AS fqn, split_part(substr(id, 8), '#', 2) AS signature FROM nodes WHERE starts_with(id, 'method:')")
def sca1(spark, sf):
    n = commerce(spark, sf).nodes.where(F.col("id").startswith("method:"))
    return n.select("id", S.class_fqn_from_method_id(F.col("id")).alias("fqn"), S.signature_from_method_id(F.col("id")).alias("signature"))


@query("sca2_simple_names", "SELECT fqn, simple_name FROM sides")
def sca2(spark, sf):
    return parties(spark, sf).select("fqn", S.simple_name(F.col("fqn")).alias("simple_name"))


@query("sca3_annotation_names", "SELECT p_partkey, p_brand AS name FROM part", graph=False)
def sca3(spark, sf):
    text = F.concat(F.lit(" @a.b."), "p_brand", F.lit("(x = 1)"))
    return table(spark, sf, "part").select("p_partkey", S.annotation_name(text).alias("name"))


@query("sca4_build_fqn", "SELECT p_partkey, 'shop.' || p_brand || CASE WHEN p_size % 2 = 0 THEN '' ELSE '.Odd' END || '.T' AS fqn FROM part", graph=False)
def sca4(spark, sf):
    enclosing = F.array("p_brand", F.when(F.col("p_size") % 2 == 0, "").otherwise("Odd"))
    return table(spark, sf, "part").select("p_partkey", S.build_fqn(F.lit("shop"), enclosing, F.lit("T")).alias("fqn"))


@query("sca5_resolve_fqn", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'java.util.List' WHEN 1 THEN 'java.lang.String' WHEN 2 THEN 'java.io.Other' ELSE 'a.b.Own' END AS fqn FROM part", graph=False)
def sca5(spark, sf):
    name = F.element_at(F.array(*[F.lit(x) for x in ("List", "String", "Other", "a.b.Own")]), (F.col("p_size") % 4 + 1).cast("int"))
    imports = F.array(F.struct(F.lit("java.util.List").alias("name"), F.lit(False).alias("is_static"), F.lit(False).alias("is_wildcard")), F.struct(F.lit("java.io").alias("name"), F.lit(False).alias("is_static"), F.lit(True).alias("is_wildcard")))
    return table(spark, sf, "part").select("p_partkey", S.resolve_fqn(name, F.lit("own"), imports).alias("fqn"))


@query("sca6_tokens", "SELECT doc_id, CAST(CASE WHEN trim(text) = '' THEN 0 ELSE greatest(1, length(text) // 4) END AS BIGINT) AS tokens FROM documents", graph=False)
def sca6(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.token_estimate(F.col("text")).alias("tokens"))


@query("sca7_cosine", VECTOR_SQL.replace("SELECT label,", "SELECT vec_id,") + "SELECT vec_id, round(s, 4) AS score FROM s", graph=False)
def sca7(spark, sf):
    q = F.array(*[F.lit(float(x)) for x in _first_vector(spark, sf)])
    return table(spark, sf, "embeddings").select("vec_id", F.round(S.cosine(F.col("embedding"), q), 4).alias("score"))


@query("sca8_sha256", "SELECT doc_id, sha256(text) AS sha256 FROM documents", graph=False)
def sca8(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.content_hash(F.col("text").cast("binary")).alias("sha256"))


@query("sca9_json_path", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events", graph=False)
def sca9(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("sca10_escapes", """SELECT item_id, replace(text || '''', '''', '\\''') AS js, replace(replace(replace(text || '&<"', '&', '&amp;'), '<', '&lt;'), '"', '&quot;') AS xml FROM benchmark""", graph=False)
def sca10(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", S.escape_quotes(F.concat("text", F.lit("'"))).alias("js"), S.escape_xml(F.concat("text", F.lit('&<"'))).alias("xml"))


@query("sca11_slugs", "SELECT DISTINCT c_mktsegment AS category, 'tech-' || replace(lower(c_mktsegment || ' X'), ' ', '-') AS slug FROM customer", graph=False)
def sca11(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_mktsegment").alias("category")).distinct().withColumn("slug", S.tech_slug(F.concat("category", F.lit(" X"))))


@query("sca12_provenance", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'EXTRACTED' WHEN 1 THEN 'INFERRED' ELSE 'EXTRACTED' END AS provenance FROM orders", graph=False)
def sca12(spark, sf):
    raw = F.when(F.col("o_orderkey") % 3 == 0, "  ").when(F.col("o_orderkey") % 3 == 1, "inferred")
    return table(spark, sf, "orders").select("o_orderkey", S.provenance(raw).alias("provenance"))


@query("sca13_language", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'JAVA' WHEN 1 THEN 'PYTHON' ELSE 'RUST' END AS language FROM part", graph=False)
def sca13(spark, sf):
    path = F.concat("p_name", F.lit("."), F.element_at(F.array(F.lit("java"), F.lit("PY"), F.lit("rs")), (F.col("p_size") % 3 + 1).cast("int")))
    return table(spark, sf, "part").select("p_partkey", S.language_of(path).alias("language"))


@query("sca14_colours", "SELECT n_nationkey, ['#4e79a7', '#f28e2b', '#e15759', '#76b7b2', '#59a14f', '#edc948', '#b07aa1', '#ff9da7'][n_nationkey % 8 + 1] AS colour FROM nation", graph=False)
def sca14(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", S.community_colour(F.col("n_nationkey")).alias("colour"))


# ---- upserts and mutations


@query("snk2_upsert_types", "SELECT fqn, CASE WHEN community_id % 2 = 0 THEN 'MIGRATED' ELSE status END AS status, community_id FROM classes")
def snk2(spark, sf):
    g = commerce(spark, sf)
    new = g.classes().where("community_id % 2 = 0").withColumns({"status": F.lit("MIGRATED"), "community_id": F.lit(None).cast("long")})
    return M.upsert_nodes(g, new).classes().select("fqn", "status", "community_id")


@query("snk6_insert_edges", "SELECT type, from_id, to_id, weight FROM edges UNION ALL SELECT DISTINCT 'MENTIONS', 'class:' || fqn, 'class:' || ns, CAST(9 AS DOUBLE) FROM sides WHERE side = 's'")
def snk6(spark, sf):
    g = commerce(spark, sf)
    base = g.edges.where("type = 'EXTENDS'")
    new = base.withColumns({"weight": F.lit(7.0), "seq": F.lit(0)}).unionByName(base.withColumns({"type": F.lit("MENTIONS"), "weight": F.lit(9.0), "seq": F.lit(1)})).unionByName(base.withColumns({"type": F.lit("MENTIONS"), "weight": F.lit(8.0), "seq": F.lit(2)}))
    return M.add_edges(g, new).edges.select("type", "from_id", "to_id", "weight")


@query("mut1_status", "SELECT id, CASE WHEN starts_with(id, 'tech:') THEN 'IN_PROGRESS' ELSE status END AS status FROM nodes")
def mut1(spark, sf):
    g = commerce(spark, sf)
    return M.set_status(g, g.nodes.where(F.col("id").startswith("tech:")).select("id", F.lit("IN_PROGRESS").alias("new_status"))).nodes.select("id", "status")


@query("mut2_rename_methods", "WITH r AS (SELECT type, CASE WHEN starts_with(from_id, 'method:') THEN from_id || 'x' ELSE from_id END AS from_id, CASE WHEN starts_with(to_id, 'method:') THEN to_id || 'x' ELSE to_id END AS to_id FROM edges) SELECT * FROM r")
def mut2(spark, sf):
    g = commerce(spark, sf)
    renames = g.nodes.where(F.col("id").startswith("method:")).select(F.col("id").alias("old_id"), F.concat("id", F.lit("x")).alias("new_id"))
    return M.rename_methods(g, renames).edges.select("type", "from_id", "to_id")


@query("mut3_cascade_delete", BEFORE + "SELECT type, count(*) AS edges FROM old_edges GROUP BY 1")
def mut3(spark, sf):
    return A.edge_counts(_before(commerce(spark, sf)))


@query("mut4_delete_files", "WITH f AS (SELECT fqn FROM sides WHERE ns IN (SELECT min(ns) FROM geo)) SELECT id FROM nodes WHERE CASE WHEN starts_with(id, 'method:') THEN split_part(substr(id, 8), '#', 1) ELSE fqn END NOT IN (SELECT fqn FROM f)")
def mut4(spark, sf):
    g = commerce(spark, sf)
    return M.delete_files(g, g.types, g.types.agg(F.min("file_path").alias("path"))).nodes.select("id")


@query("mut5_delete_types", "SELECT id FROM nodes WHERE CASE WHEN starts_with(id, 'method:') THEN split_part(substr(id, 8), '#', 1) ELSE fqn END NOT IN (SELECT fqn FROM sides WHERE side = 'c' AND key % 2 = 0)")
def mut5(spark, sf):
    g = commerce(spark, sf)
    return M.delete_types(g, parties(spark, sf).where("side = 'c' AND key % 2 = 0").select("fqn")).nodes.select("id")


# ---- contexts and exports


_TOLD = json.dumps(X.INSTRUCTIONS, separators=(",", ":"))


def context_sql(budget: int) -> str:
    """Contexts of all methods: head, then the skeletons of neighbours while they fit."""
    return f"""WITH called AS (SELECT x.fqn, x.signature, string_agg('{{"n":"' || y.name || '","sig":"' || y.signature || '","rt":"' || y.return_type || '"}}', ',' ORDER BY y.signature) AS c FROM methods x JOIN methods y ON x.fqn = y.fqn AND x.name = y.name GROUP BY 1, 2),
first5 AS (SELECT community_id, fqn, row_number() OVER (PARTITION BY community_id ORDER BY fqn) AS r FROM classes WHERE community_id IS NOT NULL),
sums AS (SELECT community_id, 'Community ' || CAST(community_id AS VARCHAR) || ' contains ' || CAST(count(*) AS VARCHAR) || ' types: ' || string_agg(fqn, ', ' ORDER BY fqn) FILTER (r <= 5) AS summary FROM first5 GROUP BY 1),
heads AS (SELECT m.fqn, m.signature, m.raw_body, '{{"t":"surgical","c":' || CAST(sides.community_id AS VARCHAR) || coalesce(',"cs":"' || summary || '"', '') || ',"_instructions":{_TOLD},"tgt":{{"cls":"' || simple_name || '","fqn":"' || m.fqn || '","m":"' || name || '","sig":"' || m.signature || '","body":"' || raw_body || '","calls":[' || c || ']}}' AS head FROM methods m JOIN sides ON sides.fqn = m.fqn LEFT JOIN sums ON sums.community_id = sides.community_id JOIN called c ON c.fqn = m.fqn AND c.signature = m.signature),
sized AS (SELECT *, (length(head) + 1) // 4 AS used FROM heads),
listed AS (SELECT fqn, '"' || string_agg(signature, '","' ORDER BY signature) || '"' AS l FROM methods GROUP BY 1),
skeleton AS (SELECT n.fqn, '{{"fqn":"' || n.fqn || '","cls":"' || simple_name || '","methods":[' || coalesce(l, '') || '],"fields":[]}}' AS s FROM nodes n LEFT JOIN listed ON listed.fqn = n.fqn WHERE starts_with(id, 'class:')),
shown AS (SELECT near1.fqn, other, s, length(s) // 4 AS tokens, sum(length(s) // 4) OVER (PARTITION BY near1.fqn ORDER BY other ROWS UNBOUNDED PRECEDING) AS running FROM (SELECT DISTINCT fqn, other FROM near WHERE type IN ('DEPENDS_ON', 'CALLS', 'EXTENDS', 'IMPLEMENTS') AND fqn <> other) near1 JOIN skeleton ON skeleton.fqn = other),
contexts AS (SELECT z.fqn, z.signature AS wanted, any_value(raw_body) AS raw_body, any_value(head) || ',"nbr":[' || coalesce(string_agg(s, ',' ORDER BY other), '') || ']}}' AS context,
  CAST(any_value(used) + coalesce(sum(tokens), 0) AS BIGINT) AS tokens, z.fqn || coalesce(',' || string_agg(other, ',' ORDER BY other), '') AS included FROM sized z LEFT JOIN shown ON shown.fqn = z.fqn AND running <= {budget} - used GROUP BY z.fqn, z.signature) """


def _contexts(spark, sf, budget, more=()):
    g = commerce(spark, sf)
    return X.method_contexts(g, g.methods.select("fqn", F.col("signature").alias("wanted")), budget, A.summaries(g), more).withColumn("included", F.array_join("included", ","))


@query("ctx1_method_context", context_sql(500) + "SELECT fqn, wanted, context, tokens, included FROM contexts")
def ctx1(spark, sf):
    return _contexts(spark, sf, 500)


@query("agg17_token_benchmark", context_sql(500) + "SELECT CAST(floor(sum(length(raw_body)) / 4) AS BIGINT) AS raw_tokens, CAST(sum(length(context) // 4) AS BIGINT) AS context_tokens FROM contexts")
def agg17(spark, sf):
    rows = _contexts(spark, sf, 500, ("raw_body",))  # beside its context, which so need not be shuffled
    return A.token_benchmark(F.col("raw_body"), F.col("context"), rows).select("raw_tokens", F.col("context_tokens").cast("long").alias("context_tokens"))


@query("ctx2_class_context", """WITH m AS (SELECT fqn, string_agg('{"name":"' || name || '","signature":"' || signature || '","return_type":"' || return_type || '","raw_body":"' || raw_body || '"}', ',' ORDER BY signature) AS body FROM methods GROUP BY 1),
t AS (SELECT c.fqn, '{"t":"class_wide","c":' || CAST(community_id AS VARCHAR) || ',"metadata":{"file_path":"' || regexp_replace(c.fqn, '\\.[^.]*$', '') || '.java","package_name":"' || regexp_replace(c.fqn, '\\.[^.]*$', '') || '","class_name":"' || simple_name || '"},"methods":[' || coalesce(body, '') || ']}' AS context FROM classes c LEFT JOIN m ON m.fqn = c.fqn)
SELECT fqn, context, CAST(least(3000, greatest(1, length(context) // 4)) AS BIGINT) AS tokens FROM t""")
def ctx2(spark, sf):
    g = commerce(spark, sf)
    return X.class_contexts(g, g.classes().select("fqn"))


@query("ctx3_surgical_context", context_sql(1_000_000_000) + "SELECT fqn, wanted, context, tokens, included FROM contexts")
def ctx3(spark, sf):
    return _contexts(spark, sf, None)


@query("snk12_graph_json", """WITH e AS (SELECT *, row_number() OVER (ORDER BY type, a, b) AS i FROM class_links), n AS (SELECT *, row_number() OVER (ORDER BY fqn) AS i FROM classes)
SELECT '{"nodes":[' AS line UNION ALL SELECT '],"edges":[' UNION ALL SELECT ']}'
UNION ALL SELECT CASE WHEN i = 1 THEN '' ELSE ',' END || '{"id":"' || fqn || '","label":"' || simple_name || '","community":' || CAST(community_id AS VARCHAR) || '}' FROM n
UNION ALL SELECT CASE WHEN i = 1 THEN '' ELSE ',' END || '{"source":"' || a || '","target":"' || b || '","type":"' || type || '","provenance":"EXTRACTED","confidence":1.0}' FROM e""")
def snk12(spark, sf):
    return E.graph_json(commerce(spark, sf)).select("line")


def _fixed(lines, part: int) -> str:
    """SQL rows (part, line) of fixed lines."""
    return " UNION ALL ".join("SELECT {} AS part, '{}' AS line".format(part, x.replace("'", "''")) for x in lines)


@query("snk13_graph_html", f"""WITH e AS (SELECT *, row_number() OVER (ORDER BY type, a, b) AS i FROM class_links)
SELECT * FROM ({_fixed(E.HTML_HEAD, 0)})
UNION ALL SELECT 1, '["' || fqn || '","' || simple_name || '",' || CAST(community_id AS VARCHAR) || ',"' || ['#4e79a7', '#f28e2b', '#e15759', '#76b7b2', '#59a14f', '#edc948', '#b07aa1', '#ff9da7'][community_id % 8 + 1] || '"],' FROM classes
UNION ALL SELECT 2, '{E.HTML_BETWEEN}' UNION ALL SELECT 3, '["' || a || '","' || b || '","' || type || '"],' FROM e
UNION ALL SELECT * FROM ({_fixed(E.HTML_TAIL, 99)})""")
def snk13(spark, sf):
    return E.graph_html(commerce(spark, sf)).select("part", "line")


@query("snk14_graphml", "SELECT '<edge id=\"e' || CAST(row_number() OVER (ORDER BY type, a, b) - 1 AS VARCHAR) || '\" source=\"' || a || '\" target=\"' || b || '\"/>' AS line FROM class_links")
def snk14(spark, sf):
    return E.graphml(commerce(spark, sf)).where("part = 2").select("line")


@query("snk15_svg_grid", "WITH n AS (SELECT greatest(1, CAST(ceil(sqrt(count(*))) AS BIGINT)) AS cols FROM classes), r AS (SELECT fqn, row_number() OVER (ORDER BY fqn) - 1 AS i FROM classes) SELECT fqn, CAST(40 + (i % cols) * 120 AS BIGINT) AS x, CAST(40 + (i // cols) * 40 AS BIGINT) AS y FROM r, n")
def snk15(spark, sf):
    return E.svg_grid(commerce(spark, sf)).select("fqn", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))


@query("snk16_wiki", LABELS + """, s AS (SELECT community_id, count(*) AS members FROM classes WHERE community_id IS NOT NULL GROUP BY 1),
i AS (SELECT x.community_id, count(*) AS n FROM class_links l JOIN classes x ON x.fqn = l.a JOIN classes y ON y.fqn = l.b AND x.community_id = y.community_id GROUP BY 1),
h AS (SELECT s.community_id, CASE WHEN members < 2 THEN 1.0 ELSE least(1.0, coalesce(n, 0) / (members * (members - 1) / 2.0)) END AS cohesion FROM s LEFT JOIN i USING (community_id)),
l AS (SELECT community_id, string_agg('- `' || fqn || '`' || chr(10), '' ORDER BY fqn) AS lines FROM classes GROUP BY 1)
SELECT 'community-' || CAST(lab.community_id AS VARCHAR) || '.md' AS file, '# ' || label || chr(10) || chr(10) || 'Cohesion: ' || format('{:.2f}', CAST(cohesion AS DOUBLE)) || chr(10) || chr(10) || '## Types' || chr(10) || chr(10) || lines AS text FROM lab JOIN h ON h.community_id = lab.community_id JOIN l ON l.community_id = lab.community_id
UNION ALL SELECT 'index.md', '# Codebase wiki' || chr(10) || chr(10) || string_agg('- [' || label || '](community-' || CAST(community_id AS VARCHAR) || '.md)' || chr(10), '' ORDER BY community_id) FROM lab""")
def snk16(spark, sf):
    return E.wiki(A.insights(commerce(spark, sf)))


@query("snk17_cypher", "SELECT 'MERGE (n:Type {fqn: ''' || fqn || '''});' AS line FROM classes UNION ALL SELECT 'MATCH (a:Type {fqn: ''' || a || '''}), (b:Type {fqn: ''' || b || '''}) MERGE (a)-[:' || type || ']->(b);' FROM class_links")
def snk17(spark, sf):
    return E.cypher(commerce(spark, sf)).select("line")


@query("snk18_report")
def snk18(spark, sf):
    g = commerce(spark, sf)
    hubs, surprising = pinned(A.hubs(g), "report-hubs"), pinned(A.surprising(g), "report-surprises")  # ten rows each, asked for twice
    return E.report(A.graph_stats(g), hubs, surprising, A.suggested_questions(g, hubs, surprising), A.insights(g))


# ---- streams: the driver's events as mutations of their users


def _event_stream(spark, sf) -> DataFrame:
    # A glob serves a single file and a folder of parts alike.
    rows = spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema).parquet(f"{sf}/events.parque[t]")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _mutated(spark, sf, of) -> DataFrame:
    """The commerce graph as a log, after a stream of events over it: its nodes (id, status) and edges, in one table (kind, a, b)."""
    place = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    log, whole = GraphLog(spark, f"{place}/graph"), commerce(spark, sf)
    log.create(Graph(whole.nodes, whole.edges))
    rows = of(_event_stream(spark, sf)).withColumn("timestamp", F.col("ts"))
    mutate_log(rows.select("kind", "node_id", "new_signature", "timestamp"), log, f"{place}/state").awaitTermination()
    after = log.graph()
    return after.nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("status").alias("b")).union(after.edges.select("type", "from_id", "to_id"))


def _of_customers(spark, sf, events: DataFrame, kind: str) -> DataFrame:
    own = parties(spark, sf).where("side = 'c'").select(F.col("key").alias("user_id"), "fqn")
    return events.join(own, "user_id").select(F.lit(kind).alias("kind"), S.class_id(F.col("fqn")).alias("node_id"), F.lit(None).cast("string").alias("new_signature"), "ts")


@query("str1_split_graph", """WITH gone AS (SELECT 'class:' || fqn AS id FROM sides WHERE side = 'c' AND key IN (SELECT user_id FROM events WHERE event_type = 'error'))
SELECT 'node' AS kind, id AS a, status AS b FROM nodes WHERE id NOT IN (SELECT id FROM gone)
UNION ALL SELECT type, from_id, to_id FROM edges WHERE from_id NOT IN (SELECT id FROM gone) AND to_id NOT IN (SELECT id FROM gone)""")
def str1_graph(spark, sf):
    """Types of users with errors are split: they go with their edges."""
    return _mutated(spark, sf, lambda events: _of_customers(spark, sf, events.where("event_type = 'error'"), SPLIT))


@query("str2_renamed_graph", """WITH ren AS (SELECT 'method:' || fqn || '#' || signature AS old_id, 'method:' || fqn || '#' || signature || 'v' || json_extract_string(props, '$.k') AS new_id FROM methods JOIN events ON signature = CAST(event_id AS VARCHAR) AND event_type = 'click')
SELECT 'node' AS kind, coalesce(new_id, id) AS a, status AS b FROM nodes LEFT JOIN ren ON old_id = id
UNION ALL SELECT type, coalesce(x.new_id, from_id), coalesce(y.new_id, to_id) FROM edges LEFT JOIN ren x ON x.old_id = from_id LEFT JOIN ren y ON y.old_id = to_id""")
def str2_graph(spark, sf):
    """Clicks give the method of their number a new signature."""
    # An order's own number is its method's signature: clicks meet orders by it before their customers' names are looked up.
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("signature"), F.col("o_custkey").alias("key"))
    customers = parties(spark, sf).where("side = 'c'").select("key", "fqn")

    def of(events: DataFrame) -> DataFrame:
        clicks = events.where("event_type = 'click'").select(F.col("event_id").cast("string").alias("signature"), F.get_json_object("props", "$.k").alias("k"), "ts")
        methods = clicks.join(orders, "signature").join(customers, "key")
        return methods.select(F.lit(SIGNATURE).alias("kind"), S.method_id(F.col("fqn"), F.col("signature")).alias("node_id"), F.concat("signature", F.lit("v"), "k").alias("new_signature"), "ts")

    return _mutated(spark, sf, of)


@query("str3_migrated_graph", """WITH moved AS (SELECT 'class:' || fqn AS id FROM sides WHERE side = 'c' AND key IN (SELECT user_id FROM events WHERE event_type = 'view'))
SELECT 'node' AS kind, id AS a, CASE WHEN id IN (SELECT id FROM moved) THEN 'MIGRATED' ELSE status END AS b FROM nodes UNION ALL SELECT type, from_id, to_id FROM edges""")
def str3_graph(spark, sf):
    """Types of users with views are migrated."""
    return _mutated(spark, sf, lambda events: _of_customers(spark, sf, events.where("event_type = 'view'"), MIGRATED))


# ---- tables beside the graph: written, upserted and scanned


def _log(spark) -> GraphLog:
    log = GraphLog(spark, f"{shared_dir(spark)}/log-{uuid.uuid4().hex}")
    log.create()
    return log


@query("src15_saved_answers", """WITH t AS (SELECT *, lead(text) OVER w AS answer, lead(role) OVER w AS replier FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id * 100000 + turn AS id, text AS question, CASE WHEN conv_id % 2 = 0 THEN 'seen: ' || answer ELSE answer END AS answer, 'conversation:' || CAST(conv_id AS VARCHAR) AS nodes FROM t WHERE role = 'user' AND replier = 'assistant'""", graph=False)
def src15_answers(spark, sf):
    """Every question that was answered, saved with its conversation, those of even conversations saved again."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf, "conversations").withColumns({"answer": F.lead("text").over(w), "replier": F.lead("role").over(w)}).where("role = 'user' AND replier = 'assistant'")
    rows = t.select((F.col("conv_id") * 100_000 + F.col("turn")).alias("id"), F.col("text").alias("question"), "answer", F.lit(0).cast("long").alias("created_at"), F.array(F.concat(F.lit("conversation:"), F.col("conv_id").cast("string"))).alias("node_ids"), "conv_id")
    log = _log(spark)
    R.save_answers(log, rows.drop("conv_id"))
    R.save_answers(log, rows.where("conv_id % 2 = 0").withColumn("answer", F.concat(F.lit("seen: "), "answer")).drop("conv_id"))
    return R.answers(log).select("id", "question", "answer", F.array_join("node_ids", ",").alias("nodes"))


@query("snk7_saved_embeddings", "SELECT 'class:v' || CAST(vec_id AS VARCHAR) AS node_id, len(embedding) AS width, round(CAST(CASE WHEN vec_id % 3 = 0 THEN embedding[len(embedding)] ELSE embedding[1] END AS DOUBLE), 6) AS first FROM embeddings WHERE len(embedding) > 0", graph=False)
def snk7_embeddings(spark, sf):
    """Every vector, saved by its node, every third saved again in reverse."""
    rows = table(spark, sf, "embeddings").select(F.concat(F.lit("class:v"), F.col("vec_id").cast("string")).alias("node_id"), F.col("vec_id").cast("string").alias("fqn"), F.lit("CLASS").alias("kind"), F.col("embedding").alias("vector"), "vec_id")
    log = _log(spark)
    R.save_embeddings(log, rows.drop("vec_id"))
    R.save_embeddings(log, rows.where("vec_id % 3 = 0").withColumn("vector", F.reverse("vector")).drop("vec_id"))
    return log.table("embeddings").select("node_id", F.size("vector").cast("long").alias("width"), F.round(F.col("vector")[0].cast("double"), 6).alias("first"))


@query("snk8_saved_labels", LABELS + " SELECT community_id, CASE WHEN community_id % 2 = 0 THEN label || ' again' ELSE label END AS label FROM lab")
def snk8_labels(spark, sf):
    """Labels of all communities, those of even number saved again."""
    rows, log = A.labels(commerce(spark, sf)).select("community_id", "label"), _log(spark)
    R.save_labels(log, rows)
    R.save_labels(log, rows.where("community_id % 2 = 0").withColumn("label", F.concat("label", F.lit(" again"))))
    return log.table("labels").select("community_id", "label")


@query("snk10_saved_hyperedges", HITS + """, e AS (SELECT 'tech-' || replace(lower(category), ' ', '-') AS id, category || ' users' AS label, list_sort(list(DISTINCT fqn)) AS m FROM hits GROUP BY category HAVING count(DISTINCT fqn) >= 3)
SELECT id, label, array_to_string(CASE WHEN id LIKE '%1' THEN m[2:3] ELSE m END, ',') AS members FROM e""")
def snk10_hyperedges(spark, sf):
    """Users of each technology as a hyperedge; one is saved again with its second and third member alone."""
    rows, log = A.technology_hyperedges(_hits(spark, sf)), _log(spark)
    R.save_hyperedges(log, rows)
    R.save_hyperedges(log, rows.where("id LIKE '%1'").withColumn("node_ids", F.slice("node_ids", 2, 2)))
    return R.hyperedges(log).select("id", "label", F.array_join("node_ids", ",").alias("members"))


@query("str1_split_users", "SELECT DISTINCT user_id FROM events WHERE event_type = 'error'", graph=False)
def str1(spark, sf):
    return drain(_event_stream(spark, sf).where("event_type = 'error'").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")), "str1").select("user_id")


@query("str2_last_signature", "SELECT user_id, arg_max(props, (ts, event_id)) AS props FROM events WHERE event_type = 'click' GROUP BY 1", graph=False)
def str2(spark, sf):
    return drain(_event_stream(spark, sf).where("event_type = 'click'").groupBy("user_id").agg(F.max_by("props", F.struct("ts", "event_id")).alias("props")), "str2")


@query("str3_last_status", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, count(*) AS events FROM events GROUP BY 1", graph=False)
def str3(spark, sf):
    return drain(_event_stream(spark, sf).groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.count(F.lit(1)).alias("events")), "str3")


@query("str4_daily_batches", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS events FROM events GROUP BY 1, 2", graph=False)
def str4(spark, sf):
    counts = _event_stream(spark, sf).withWatermark("ts", "1 day").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"))
    return drain(counts, "str4").select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "events")


# ---- rules and embedders on the driver's texts


@query("prj12_rule_hits", "SELECT page_id AS fqn, CASE WHEN starts_with(url, 'https://') THEN 'secure' ELSE 'plain' END AS id FROM pages WHERE starts_with(url, 'http')", graph=False)
def prj12(spark, sf):
    none = F.array().cast("array<struct<annotations:array<string>>>")
    methods = F.array().cast("array<struct<annotations:array<string>,parameters:array<struct<annotations:array<string>>>>>")
    types = table(spark, sf, "pages").select(F.col("page_id").alias("fqn"), F.array("url").alias("imports"), F.lit(None).cast("string").alias("super_class"), F.array().cast("array<string>").alias("interfaces"), F.array().cast("array<string>").alias("annotations"), methods.alias("methods"), *[none.alias(c) for c in ("fields", "enum_constants", "record_components")])
    rules = _one(spark, RULES, ("secure", "Secure", "web", ([], ["https://"], [], [])), ("plain", "Plain", "web", ([], ["http://"], [], [])))
    return L.rule_hits(types, rules).select("fqn", "id")


@query("prj13_annotation_hits", "SELECT doc_id AS fqn, lang AS id FROM documents WHERE lang IN ('en', 'fr')", graph=False)
def prj13(spark, sf):
    none = F.array().cast("array<struct<annotations:array<string>>>")
    methods = F.array(F.struct(F.array(F.concat(F.lit("@a.b."), "lang", F.lit("(x = 1)"))).alias("annotations"), none.alias("parameters")))
    types = table(spark, sf, "documents").select(F.col("doc_id").alias("fqn"), F.array().cast("array<string>").alias("imports"), F.lit(None).cast("string").alias("super_class"), F.array().cast("array<string>").alias("interfaces"), F.array().cast("array<string>").alias("annotations"), methods.alias("methods"), *[none.alias(c) for c in ("fields", "enum_constants", "record_components")])
    rules = _one(spark, RULES, ("en", "English", "lang", (["x.y.en"], [], [], [])), ("fr", "French", "lang", (["fr"], [], [], [])))
    return L.rule_hits(types, rules).select("fqn", "id")


@query("ext5_embedded_texts", "SELECT item_id, TRUE AS embedded FROM benchmark", graph=False)
def ext5(spark, sf):
    made = V.hashing_vectors(table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text"))
    return made.select(F.col("id").alias("item_id"), (F.size("vector") == 64).alias("embedded"))


@query("gra9_removal_order")
def gra9(spark, sf):
    """Edges in the order of their betweenness, for the types of each nation: components of bounded size."""
    g = commerce(spark, sf)
    of = g.classes().select("id", "community_id")
    inside = g.edges.where("type = 'DEPENDS_ON'").join(of.select(F.col("id").alias("from_id"), F.col("community_id").alias("c")), "from_id").join(of.select(F.col("id").alias("to_id"), F.col("community_id").alias("d")), "to_id").where("c = d")
    nations = g.with_(edges=inside.select(*g.edges.columns))
    return C.removal_order(nations, C.components(nations)).withColumn("betweenness", F.round("betweenness", 6))
