"""The index of vectors by angle, and what is stored beside a graph."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeweft.changelog import GraphLog
from codeweft.operators import lookups as L
from codeweft.operators import records as R
from codeweft.operators import vectors as V
from codeweft.streaming import events as E

from test_changes import EVENTS, frame, small_graph


def plain_pairs(rows, threshold):
    x = np.array([v for _, v in rows], float)
    norm = np.sqrt((x * x).sum(axis=1))
    unit = x / np.where(norm > 0, norm, 1)[:, None]
    scores = unit @ unit.T
    out = {}
    for i, j in np.argwhere(scores >= threshold):
        a, b = rows[i][0], rows[j][0]
        if a < b:
            out[a, b] = max(out.get((a, b), -2), round(float(scores[i, j]), 9))
    return out


def clustered(n, centres, spread, width=16, seed=1):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, width))
    return [(f"t{i:05d}", (middle[i % centres] + spread * rng.normal(size=width)).tolist()) for i in range(n)]


@pytest.mark.parametrize("threshold", [0.95, 0.5, 0.0, -0.2])
def test_pairs_equal_brute_force(spark, threshold):
    rows = clustered(300, 12, 0.15) + [("z0", [0.0] * 16), ("z1", [0.0] * 16), ("twin", [1.0] * 16), ("twin2", [2.0] * 16)]
    frame_ = spark.createDataFrame([*rows, ("none", None), ("empty", [])], "fqn string, vector array<double>")
    got = {(r["a"], r["b"]): round(r["score"], 9) for r in V.similar_pairs(frame_, threshold, block_rows=20).collect()}
    assert got == plain_pairs(rows, threshold)


def test_most_pairs_of_blocks_are_skipped_on_clustered_vectors(spark):
    rows = clustered(4000, 40, 0.05)
    frame_ = spark.createDataFrame(rows, "fqn string, vector array<double>")
    index = V.angle_index(frame_, block_rows=50)
    blocks = index.blocks.count()
    kept = index.pairs(0.95).count()
    assert kept < 0.25 * blocks * (blocks + 1) / 2, (kept, blocks)
    got = {(r["a"], r["b"]) for r in V.similar_pairs(frame_, 0.95, block_rows=50).select("a", "b").collect()}
    assert got == set(plain_pairs(rows, 0.95))


def test_a_crowd_around_one_pivot_is_many_blocks(spark):
    rows = [(f"t{i:04d}", [1.0, 2.0, 3.0]) for i in range(400)] + clustered(100, 5, 0.2, 3)
    index = V.angle_index(spark.createDataFrame(rows, "fqn string, vector array<double>"), block_rows=40)
    largest = index.rows.groupBy("block").count().agg(F.max("count")).first()[0]
    assert largest < 160


def test_no_vectors(spark):
    none = spark.createDataFrame([], "fqn string, vector array<double>")
    assert V.similar_pairs(none).collect() == []


def test_seeds_by_name_without_a_nested_loop(spark):
    names = ["Dog", "zoo.Dog", "Animal", "É", "a.very.long.name.of.a.Type", "A.VERY.LONG.NAME.of.a.Kind", "", "Dog", None]
    questions = [(1, "what does zoo.dog do with an animal"), (2, "a.very.long.name.of.a.kind?"), (3, "é"), (4, None), (5, "")]
    got = sorted(tuple(r) for r in L.seeds_by_name(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(questions, "question_id int, question string"), 20).collect())
    want = []
    for i, q in questions:
        hits = sorted(n for n in names if n is not None and q is not None and n.lower() in q.lower())
        want += [(i, n, k) for k, n in enumerate(hits, 1)]
    assert got == sorted(want)
    plan = L.seeds_by_name(spark.createDataFrame([("Dog",)], "name string"), spark.createDataFrame(questions, "question_id int, question string"))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_records_upsert_scan_and_go_with_their_nodes(spark, tmp_path):
    log = GraphLog(spark, f"file://{tmp_path}/log")
    log.create(small_graph(spark, 6))
    vectors = "node_id string, fqn string, kind string, vector array<float>"
    R.save_embeddings(log, spark.createDataFrame([("class:p.T1", "p.T1", "CLASS", [1.0, 0.0]), ("class:p.T2", "p.T2", "CLASS", [0.0, 1.0]), ("class:p.T3", "p.T3", "CLASS", []), ("class:p.T4", "p.T4", "CLASS", None)], vectors))
    R.save_embeddings(log, spark.createDataFrame([("class:p.T2", "p.T2", "CLASS", [0.5, 0.5])], vectors))
    assert {r["node_id"]: list(r["vector"]) for r in log.table("embeddings").collect()} == {"class:p.T1": [1.0, 0.0], "class:p.T2": [0.5, 0.5]}
    R.save_labels(log, spark.createDataFrame([(1, "one"), (2, "two")], "community_id long, label string"))
    R.save_labels(log, spark.createDataFrame([(2, "zwei")], "community_id long, label string"))
    assert {tuple(r) for r in log.table("labels").select("community_id", "label").collect()} == {(1, "one"), (2, "zwei")}
    edges = "id string, label string, relation string, provenance string, confidence_score double, node_ids array<string>"
    R.save_hyperedges(log, spark.createDataFrame([("h", "H", "uses", "INFERRED", 0.85, ["class:p.T3", "class:p.T1", "class:p.T2"]), ("k", "K", "uses", "INFERRED", 0.8, ["class:p.T1"])], edges))
    R.save_hyperedges(log, spark.createDataFrame([("h", "H2", "uses", "EXTRACTED", 0.9, ["class:p.T2", "class:p.T5", "class:p.T2"])], edges))
    assert {r["id"]: (r["label"], r["node_ids"]) for r in R.hyperedges(log).collect()} == {"h": ("H2", ["class:p.T2", "class:p.T5"]), "k": ("K", ["class:p.T1"])}
    R.save_answers(log, spark.createDataFrame([(7, "q", "a", 1, ["class:p.T2"]), (8, "r", "b", 2, [])], "id long, question string, answer string, created_at long, node_ids array<string>"))
    assert {r["id"]: r["node_ids"] for r in R.answers(log).collect()} == {7: ["class:p.T2"], 8: []}
    frame(spark, [("NODE_SPLIT", "class:p.T2", None, "2024-01-01 10:00:00")]).write.parquet(f"{tmp_path}/in")
    E.mutate_log(spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in"), log, f"{tmp_path}/state").awaitTermination()
    assert {r["node_id"] for r in log.table("embeddings").collect()} == {"class:p.T1"}
    assert {r["id"]: r["node_ids"] for r in R.hyperedges(log).collect()} == {"h": ["class:p.T5"], "k": ["class:p.T1"]}
    assert R.answers(log).where("id = 7").first()["node_ids"] == []
    log.compact()
    assert {r["id"]: r["node_ids"] for r in R.hyperedges(log).collect()} == {"h": ["class:p.T5"], "k": ["class:p.T1"]}
