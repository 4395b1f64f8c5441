"""Steps that must not grow faster than their input: how they are planned, and that their results stay."""

import random

from pyspark.sql import functions as F
from test_walks import random_graph

from codeweft.functions.scalars import endpoint_class
from codeweft.operators import community as C
from codeweft.operators import traverse as T
from codeweft.operators import vectors as V
from codeweft.plans.commerce import commerce

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_large_shapes_are_paired_in_blocks(spark):
    rng = random.Random(7)
    rows = [(f"t{i:03d}", rng.choice(["CLASS", "INTERFACE"]), rng.randrange(3)) for i in range(60)] + [("alone", "ENUM", 9), ("none", "CLASS", None)]
    found = V.alike_shapes(spark.createDataFrame(rows, "fqn string, kind string, method_count int"), block=4)
    got = sorted((r["a"], r["b"]) for r in found.collect())
    assert got == sorted((x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and x[1:] == y[1:] and x[2] is not None)
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_labels_move_by_number(spark):
    graph, _ = random_graph(spark, 3)
    links, labels, names = C._start(graph)
    assert dict(links.dtypes) == {"a": "bigint", "b": "bigint", "weight": "double"}
    assert [r["name"] for r in names.orderBy("n").collect()] == sorted(r["fqn"] for r in graph.classes().collect())


def test_ends_of_edges_need_no_patterns(spark):
    rows = spark.createDataFrame([("class:a.B",), ("method:a.B#m(x)",), ("method:#m",), ("tech:T",), (None,), ("class:method:x",)], "id string")
    found = rows.select(endpoint_class(rows["id"]).alias("fqn"))
    assert [r["fqn"] for r in found.collect()] == ["a.B", "a.B", "#m", None, None, "method:x"] and "regexp" not in plan(found)


def test_links_of_types_leave_methods_alone(spark):
    graph = commerce(spark, SF)
    assert "CALLS" not in plan(graph.class_links()) and graph.with_(edges=graph.edges.limit(0)).class_links().count() == 0


def test_neighbours_leave_edges_between_methods_alone(spark):
    graph = commerce(spark, SF)
    types = ("DEPENDS_ON", "CALLS", "EXTENDS", "IMPLEMENTS", "USES")
    found = graph.neighbours(types)
    assert "CALLS" not in plan(found) and plan(found).count("lineitem") <= plan(graph.edges.where("type IN ('DEPENDS_ON', 'USES')")).count("lineitem")
    assert sorted(found.collect()) == sorted(graph.with_(edges=graph.edges).neighbours(types).collect())


def test_what_a_task_holds_does_not_grow(spark, monkeypatch):
    """Steps over all edges take as many tasks as the rows ask for, and none of the edges is held before its shuffle."""
    from codeweft import storage
    from codeweft.operators import analysis as A

    few = commerce(spark, SF)
    monkeypatch.setattr(storage, "ROWS_A_PART", 100)
    many = commerce(spark, SF)
    assert many.parts > 50 > few.parts
    for step in (lambda g: g.neighbours(("DEPENDS_ON", "USES")), A.pair_weights):
        assert step(many).rdd.getNumPartitions() == many.parts
        assert sorted(step(many).collect()) == sorted(step(few).collect()) == sorted(step(few.with_(edges=few.edges)).collect())
    assert many.class_links().where("type = 'DEPENDS_ON'").rdd.getNumPartitions() == many.parts == many.edges.where("type = 'CALLS'").rdd.getNumPartitions()


def test_paths_are_found_from_the_target(spark):
    graph, links = random_graph(spark, 2)
    start = links[0][1]
    assert T.shortest_path(graph, start, start).first()["hops"] == [start] and T.shortest_path(graph, start, "nowhere").first()["hops"] == [] and T.shortest_path(graph, "nowhere", start).first()["hops"] == []


def test_many_edges_are_no_error(spark):
    from codeweft.graph import Graph

    n = 2_001
    edges = spark.createDataFrame([("DEPENDS_ON", f"class:a{i:04d}", f"class:b{i:04d}", 1.0, "EXTRACTED", 1.0) for i in range(n)], "type string, from_id string, to_id string, weight double, provenance string, confidence_score double")
    one = spark.createDataFrame([(f"a{i:04d}", "all") for i in range(n)], "fqn string, component string")
    rows = C.removal_order(Graph(edges.limit(0), edges), one).orderBy("place").collect()
    assert [(r["place"], r["a"], r["b"], r["betweenness"]) for r in rows] == [(i, f"a{i:04d}", f"b{i:04d}", 2.0) for i in range(n)]


def test_a_sieve_misses_no_key(spark):
    from codeweft.operators.sieve import sieve

    keys = spark.range(3000).selectExpr("concat('k', id) AS id", "CAST(IF(id % 7 = 0, NULL, id) AS long) AS n")
    rows = keys.withColumn("there", F.lit(True)).union(spark.range(3000, 60_000).selectExpr("concat('k', id)", "id", "false"))
    found = sieve(keys, "id", "n").marked(rows, "maybe", "id", "n").groupBy("there").agg(F.count(F.lit(1)).alias("n"), F.count_if("maybe").alias("maybe"))
    got = {r["there"]: r for r in found.collect()}
    assert got[True]["n"] == got[True]["maybe"] == 3000 and got[False]["n"] == 57_000 and got[False]["maybe"] < 4_000
    assert sieve(keys.limit(0), "id").marked(rows, "maybe", "id").where("maybe").count() == 0


def test_differences_of_rows(spark):
    from codeweft.changelog import difference

    shape = "k string, v long, m map<string,string>"
    old = spark.createDataFrame([("same", None, {"a": "b"}), ("value", 1, None), ("map", 1, {"a": "b"}), ("gone", 4, None), ("null", 1, {})], shape)
    new = spark.createDataFrame([("same", None, {"a": "b"}), ("value", 2, None), ("map", 1, {"a": "c"}), ("null", None, {}), ("new", None, None)], shape)
    got = sorted((r["k"], r["v"], r["m"], r["gone"]) for r in difference(old, new, ["k"]).collect())
    assert got == [("gone", 4, None, True), ("map", 1, {"a": "c"}, False), ("new", None, None, False), ("null", None, {}, False), ("value", 2, None, False)]


def test_a_batch_moves_what_it_may_touch(spark, tmp_path):
    """Without any broadcast of its own choice, neither a batch nor a reader shuffles the edges that no event can name."""
    from test_changes import BATCHES, send, small_graph

    from codeweft.changelog import GraphLog

    store = spark._jsc.sc().statusStore()

    def stages():
        found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    graph, log = small_graph(spark, 2000), GraphLog(spark, f"file://{tmp_path}/log")
    log.create(graph)
    edges = log.graph().edges.count()
    thresholds = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = max(stages())
    try:
        for name in thresholds:
            spark.conf.set(name, "-1")
        send(spark, tmp_path, BATCHES[:1], log)
        assert len(log.graph().edges.collect()) == edges
    finally:
        for name in thresholds:
            spark.conf.unset(name)
    assert sum(n for stage, n in stages().items() if stage > before) < edges / 4


def test_what_ends_are_travels_with_the_links(spark):
    from codeweft.operators import analysis as A

    graph = commerce(spark, SF)
    plain = graph.with_(nodes=graph.nodes)
    assert plain.linked is None and plain.numbers is None and graph.with_(edges=graph.edges).linked is None
    for found in (A.degrees, lambda g: A.surprising(g, None), A.cohesion, A.suggested_questions):
        assert sorted(map(tuple, found(graph).collect())) == sorted(map(tuple, found(plain).collect()))

    def moved(df):
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange")

    assert moved(A.surprising(graph)) < moved(A.surprising(plain)) and moved(A.cohesion(graph)) < moved(A.cohesion(plain))


def test_a_report_asks_for_hubs_and_surprises_once(spark):
    from codeweft.plans.queries import QUERIES

    lines = QUERIES["snk18_report"](spark, SF)
    assert all(any(name in f for f in lines.inputFiles()) for name in ("report-hubs", "report-surprises")) and lines.where("line LIKE '- What depends on % and why is it a hub?'").count() == 1


def test_a_step_from_few_types_moves_only_their_neighbours(spark, monkeypatch):
    graph = commerce(spark, SF)
    seed = spark.createDataFrame([(graph.classes().where("kind = 'INTERFACE'").agg(F.min("fqn")).first()[0], 1)], "fqn string, rank int")
    types = ("DEPENDS_ON", "CALLS", "EXTENDS", "IMPLEMENTS", "USES")
    wide = T.breadth_first(graph, seed, 2, types)
    near = sorted(map(tuple, graph.neighbours(types).join(seed.select("fqn"), "fqn").collect()))
    monkeypatch.setattr(type(graph), "neighbours", lambda *_: 1 / 0)
    found = T.breadth_first(graph, seed, 1, types)
    assert sorted(found.collect()) == sorted(wide.where("depth < 2").collect()) and found.where("depth = 1").count() == len({other for _, _, other in near})
    assert T.answer_text(graph, found, "what", 200).first()["answer"].startswith("Query: what")


def test_an_edge_is_one_pair(spark):
    graph, types = commerce(spark, SF), ("DEPENDS_ON", "EXTENDS", "IMPLEMENTS", "USES", "CONTAINS")
    some = [("CONTAINS", "class:a", "method:b#m"), ("CALLS", "method:a#m", "class:c"), ("CALLS", "method:a#m", "method:c#n"), ("USES", "class:a", "tech:t"), ("USES", "class:a", "class:a"), ("CALLS", None, "class:c"), ("CALLS", "class:c", None)]
    edges = spark.createDataFrame([(*e, 1.0, "EXTRACTED", 1.0) for e in some], "type string, from_id string, to_id string, weight double, provenance string, confidence_score double")
    for g, kinds in ((graph, types), (graph.with_(edges=edges), ("CONTAINS", "CALLS", "USES"))):
        pairs = g.pairs(kinds)
        assert sorted(map(tuple, pairs.select("fqn", "type", "other").union(pairs.where("both").select("other", "type", "fqn")).collect())) == sorted(map(tuple, g.ends(kinds).collect()))
