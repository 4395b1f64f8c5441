"""The toxicity learner against plain FTRL-proximal, and odd samples."""

import math

import numpy as np
import pytest

from codeweft.llm import toxicity


def plain_ftrl(rows, alpha, beta, l1, l2):
    """Weights by slot after reading (slots, label) rows; slot -1 is the bias, which has no L1 penalty."""
    z, n = {}, {}

    def weight(i):
        penalty = 0 if i == -1 else l1
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= penalty else -(zi - math.copysign(penalty, zi)) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + l2)

    for slots, label in rows:
        at = [*slots, -1]
        w = {i: weight(i) for i in at}
        g = 1 / (1 + math.exp(-sum(w.values()))) - label
        for i in at:
            sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha
            z[i], n[i] = z.get(i, 0.0) + g - sigma * w[i], n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z}


def test_learner_equals_plain_ftrl():
    rng = np.random.default_rng(2)
    rows = [(rng.choice(40, rng.integers(1, 12), replace=False), int(rng.integers(0, 2))) for _ in range(300)]
    model = toxicity.Ftrl(40, alpha=0.5, l1=0.3)
    for at, label in rows:
        model.learn(at, label)
    want = plain_ftrl(rows, 0.5, 1.0, 0.3, 1.0)
    got = model.weights(np.arange(41))
    assert got == pytest.approx([want.get(i, 0.0) for i in range(40)] + [want[-1]])
    assert any(w == 0 for w in got[:-1]) and any(w != 0 for w in got[:-1])


def test_train_equals_plain_ftrl_over_the_sample(spark):
    words = ["good fine day", "bad vile rot", "fine good sun", "vile bad mud", "sun day", "mud rot bad"]
    docs = spark.createDataFrame([(i, words[i % 6]) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 6 % 2) for i in range(60)], "doc_id long, label int")
    slots, weights, bias = toxicity.train(docs, labels, epochs=3)
    picks = {r["doc_id"]: r["p"] for r in docs.selectExpr("doc_id", "xxhash64(3, doc_id) AS p").collect()}
    rows = []
    for i in sorted(range(60), key=lambda i: (picks[i], i % 6 % 2)):
        raw = words[i % 6].encode()
        rows.append((np.unique(toxicity.feature_slots(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[1]), i % 6 % 2))
    want = plain_ftrl(rows * 3, 2.0, 1.0, 3.5, 1.0)
    assert bias == pytest.approx(want.pop(-1))
    assert dict(zip(slots.tolist(), weights.tolist())) == pytest.approx({i: w for i, w in want.items() if w})


def chance(model):
    return 1 / (1 + math.exp(-model[2]))


def test_without_both_classes_the_score_is_the_share(spark, odd, none):
    docs = spark.createDataFrame([(1, "a b"), (2, "c d"), (3, None)], "doc_id long, text string")
    six = spark.createDataFrame([(i, i % 3 // 2) for i in range(1, 7)], "doc_id long, label int")
    absent = spark.createDataFrame([(i, i % 2) for i in range(50, 60)], "doc_id long, label int")
    one_found = spark.createDataFrame([(1, 0), (2, 0), (70, 1), (71, 1)], "doc_id long, label int")
    for rows, labels, share in ((docs.limit(0), six, 2 / 6), (docs, absent, 0.5), (docs, one_found, 0.5), (docs, six.where("label = 1"), 1.0), (docs, six.limit(0), 0.0), (none, six, 2 / 6)):
        model = toxicity.train(rows, labels)
        assert len(model[0]) == 0 and chance(model) == pytest.approx(share, abs=1e-6)
    assert toxicity.drop_toxic(odd, toxicity.train(odd, absent)).count() == odd.count()


def test_query_and_stage_on_empty_documents(spark, tmp_path):
    import corpus_pipeline

    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert toxicity.op9_toxicity(spark, str(tmp_path)).collect() == []
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.collect() == [] and (name == "packing" or out.columns == docs.columns)
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "x y"), (1, "a b")] * 20 + [(2, "c d"), (None, "z")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, label int")
    assert toxicity.train(docs, labels, min_rows=1)[2] == pytest.approx(toxicity.train(docs.where("text != 'x y'").distinct(), labels, min_rows=1)[2])
