"""The pipeline's stages: their decisions against the operators' own results, and their columns."""

import collections
import glob

import pyarrow.parquet as pq
from pyspark.sql import functions as F

import corpus_pipeline
from codeweft.llm import quality, toxicity
from codeweft.llm.common import pinned, shared_dir

from test_operators import plain_roots

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = pinned(stage(spark, docs, SF), "test-stage")
        ids = [r["doc_id"] for r in out.select("doc_id").collect()]
        assert set(ids) <= kept
        if name == "quality":
            good = quality.quality(docs, spark.read.parquet(f"{SF}/labels.parquet"), ["doc_id"]).where("quality >= 0.5")
            assert sorted(ids) == sorted(r["doc_id"] for r in good.collect())
        if name == "toxicity":
            raw = spark.read.parquet(f"{SF}/documents.parquet")
            model = toxicity.train(raw, toxicity.known_labels(spark.read.parquet(f"{SF}/labels.parquet")))
            assert sorted(ids) == sorted(r["doc_id"] for r in toxicity.score(docs, model, ["doc_id"]).where("toxic_score < 0.7").collect())
        if name == "near_duplicates":
            rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
            roots = plain_roots([t for _, t in rows])
            assert sorted(ids) == sorted({rows[i][0] for i in roots})
        if name == "mixing":
            assert max(collections.Counter(ids).values()) <= 2
        if name == "packing":
            full = out.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0]
            assert full <= 1024 and set(ids) == kept
        else:
            assert out.columns == columns
        docs, kept = out, set(ids)


def test_run_equals_stage_by_stage(spark):
    assert corpus_pipeline.run(spark, SF).count() == corpus_pipeline.run(spark, SF).count() > 0


def test_one_large_row_group_is_many_tasks_work(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    many = docs.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(19)))).select((F.col("doc_id") + F.col("k") * 100_000).alias("doc_id"), "text", "lang", "source", "n_chars")
    path = str(tmp_path / "documents.parquet")
    many.coalesce(1).write.parquet(path)
    before = set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/quality-bins-*"))
    kept = quality.keep_good(spark.read.parquet(path), spark.read.parquet(f"{SF}/labels.parquet"))
    (bins,) = set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/quality-bins-*")) - before
    files = [pq.ParquetFile(f).metadata for f in glob.glob(f"{bins}/*.parquet")]
    assert sum(m.num_rows for m in files) == many.count() and max(m.num_rows for m in files) < many.count() / 2
    assert kept.count() == kept.select("doc_id").distinct().count() > 0


def test_pinned_tables_have_small_row_groups(spark):
    rows = spark.range(60_000, numPartitions=1).withColumn("text", F.expr("hex(concat_ws(' ', transform(sequence(1, 32), i -> sha2(concat(id, '-', i), 256))))").substr(1, 1_000))
    bins = set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/test-groups-*"))
    pinned(rows, "test-groups")
    (path,) = set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/test-groups-*")) - bins
    groups = [m.row_group(i).total_byte_size for m in (pq.ParquetFile(f).metadata for f in glob.glob(f"{path}/*.parquet")) for i in range(m.num_row_groups)]
    assert len(groups) > 1 and max(groups) < 40 << 20
