"""The log of a graph's changes, streams of events over it, and the watch on a folder."""

import os
import time

import pytest
from pyspark.sql import functions as F

from codeweft.changelog import GraphLog
from codeweft.graph import Graph
from codeweft.streaming import events as V
from codeweft.streaming.watch import source_changes, watch

EVENTS = "kind string, node_id string, new_signature string, timestamp timestamp"


def small_graph(spark, n=40):
    nodes = [(f"class:p.T{i}", "CLASS", f"p.T{i}", f"T{i}", False, None, "PENDING") for i in range(n)]
    nodes += [(f"method:p.T{i}#m{j}()", "METHOD", f"p.T{i}#m{j}()", f"m{j}", False, None, "PENDING") for i in range(n) for j in range(3)]
    edges = [("CONTAINS", f"class:p.T{i}", f"method:p.T{i}#m{j}()", 1.0, "EXTRACTED", 1.0) for i in range(n) for j in range(3)]
    edges += [("DEPENDS_ON", f"class:p.T{i}", f"class:p.T{(i * 7 + 1) % n}", 3.0, "EXTRACTED", 1.0) for i in range(n)]
    edges += [("CALLS", f"method:p.T{i}#m0()", f"method:p.T{i}#m1()", 2.0, "EXTRACTED", 1.0) for i in range(n)]
    methods = [(f"p.T{i}", f"m{j}", f"m{j}()", "void", "{}", ["m1"]) for i in range(n) for j in range(3)]
    types = [(f"p.T{i}", f"T{i}.java", {"k": "v"}) for i in range(n)]
    return Graph(
        spark.createDataFrame(nodes, "id string, kind string, fqn string, simple_name string, external boolean, community_id long, status string"),
        spark.createDataFrame(edges, "type string, from_id string, to_id string, weight double, provenance string, confidence_score double"),
        spark.createDataFrame(methods, "fqn string, name string, signature string, return_type string, raw_body string, calls array<string>"),
        spark.createDataFrame(types, "fqn string, file_path string, language_metadata map<string,string>"),
    )


def content(graph):
    return {t: sorted(map(repr, (r.asDict() for r in getattr(graph, t).select(*sorted(getattr(graph, t).columns)).collect()))) for t in ("nodes", "edges", "methods", "types")}


BATCHES = [
    [("SIGNATURE_CHANGED", "method:p.T1#m0()", "m0(int)", "2024-01-01 10:00:00"), ("NODE_MIGRATED", "class:p.T2", None, "2024-01-01 10:00:00")],
    [("NODE_SPLIT", "class:p.T3", None, "2024-01-01 11:00:00"), ("NODE_SPLIT", "method:p.T4#m1()", None, "2024-01-01 11:00:00"), ("SIGNATURE_CHANGED", "method:p.T1#m0(int)", "m0(long)", "2024-01-01 11:00:00")],
    [("NODE_MIGRATED", "class:p.T5", None, "2024-01-01 12:00:00")],
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "kind string, node_id string, new_signature string, t string").withColumn("timestamp", F.col("t").cast("timestamp")).drop("t")


def send(spark, tmp_path, batches, log, name="in"):
    """Each batch as a file of its own, in order, one after the other through the stream."""
    for i, rows in enumerate(batches):
        frame(spark, rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        stream = spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/{name}")
        V.mutate_log(stream, log, f"{tmp_path}/state-{name}").awaitTermination()


def test_a_stream_over_the_log_equals_whole_mutations(spark, tmp_path):
    graph = small_graph(spark)
    log = GraphLog(spark, f"file://{tmp_path}/log")
    log.create(graph)
    send(spark, tmp_path, BATCHES, log)
    want = graph
    for rows in BATCHES:
        want = V.apply_events(want, frame(spark, rows))
    assert content(log.graph()) == content(want)
    assert log.commit().number == 3 and content(log.graph(0)) == content(graph)
    assert content(log.graph()) == content((log.compact(), log.graph())[1]) and log.commit().changes == []


def test_late_and_repeated_events_change_nothing(spark, tmp_path):
    log = GraphLog(spark, f"file://{tmp_path}/log")
    log.create(small_graph(spark))
    send(spark, tmp_path, [[("SIGNATURE_CHANGED", "method:p.T1#m0()", "m0(int)", "2024-01-01 10:00:00")]], log)
    before = content(log.graph())
    late = [("SIGNATURE_CHANGED", "method:p.T1#m0()", "m0(byte)", "2024-01-01 09:00:00"), ("SIGNATURE_CHANGED", "method:p.T1#m0()", "m0(int)", "2024-01-01 10:00:00")]
    send(spark, tmp_path, [late], log)
    assert content(log.graph()) == before
    # a batch that is run again after a failure: the log has its number
    again = log.commit().number
    log.append({}, batch=0)
    assert log.commit().number == again


def folder_bytes(path):
    return sum(os.path.getsize(f"{d}/{n}") for d, _, names in os.walk(path) for n in names if n.endswith(".parquet"))


def test_a_batch_writes_what_it_touches(spark, tmp_path):
    log = GraphLog(spark, f"file://{tmp_path}/log")
    log.create(small_graph(spark, 3000))
    send(spark, tmp_path, BATCHES[:1], log)
    commit = log.commit()
    assert folder_bytes(f"{tmp_path}/log/{commit.changes[-1]['folder']}") < 0.2 * folder_bytes(f"{tmp_path}/log/{commit.base['folder']}")
    rows = {t: spark.read.parquet(f"{tmp_path}/log/{commit.changes[-1]['folder']}/{t}").count() for t in ("nodes", "edges", "methods")}
    assert rows == {"nodes": 3, "edges": 4, "methods": 2}  # tombstone and row for each thing renamed, and one status


def test_truncate_and_retention_with_a_reader_on_an_old_version(spark, tmp_path):
    log = GraphLog(spark, f"file://{tmp_path}/log")
    graph = small_graph(spark)
    log.create(graph)
    old = log.graph(0)
    log.truncate()
    assert log.graph().nodes.count() == 0 and log.graph().edges.columns == graph.edges.columns
    assert content(old) == content(graph)  # a reader of version 0 goes on
    assert log.retain(2) == [] and content(old) == content(graph)
    log.create(graph)
    assert len(log.retain(2)) == 1 and log.numbers() == [1, 2] and content(log.graph()) == content(graph)


def test_two_writers_of_one_version(spark, tmp_path):
    log = GraphLog(spark, f"file://{tmp_path}/log")
    first = log.create(small_graph(spark))
    with pytest.raises(FileExistsError):
        log._put(first)


def test_watch_sees_additions_edits_and_deletions(spark, tmp_path):
    root, state = tmp_path / "src", tmp_path / "state"
    root.mkdir()
    (root / "A.java").write_text("class A {}")
    (root / "note.txt").write_text("no source")
    batches = []

    def run():
        batches.clear()
        watch(spark, str(root), lambda rows: batches.append(sorted((os.path.basename(r["path"]), r["state"], r["content"] and bytes(r["content"]).decode()) for r in rows.collect())), str(state), once=True).awaitTermination()
        return [b for b in batches if b]

    assert run() == [[("A.java", "added", "class A {}")]]
    assert run() == []
    (root / "A.java").write_text("class A { int x; }")
    (root / "B.java").write_text("class B {}")
    assert run() == [[("A.java", "changed", "class A { int x; }"), ("B.java", "added", "class B {}")]]
    (root / "A.java").unlink()
    assert run() == [[("A.java", "deleted", None)]]
    os.utime(root / "B.java", (time.time() + 50, time.time() + 50))
    assert run() == []  # touched, not edited


def test_a_running_watch_gives_each_change_one_batch(spark, tmp_path):
    root = tmp_path / "src"
    root.mkdir()
    seen = []
    query = watch(spark, str(root), lambda rows: seen.append([(os.path.basename(r["path"]), r["state"]) for r in rows.collect()]), str(tmp_path / "state"), seconds=1)

    def wait_for(want):
        end = time.time() + 60
        while want not in seen and time.time() < end:
            time.sleep(0.3)
        assert seen.count(want) == 1, seen

    try:
        for step, want in ((lambda: (root / "A.java").write_text("1"), [("A.java", "added")]), (lambda: (root / "A.java").write_text("22"), [("A.java", "changed")]), (lambda: (root / "A.java").unlink(), [("A.java", "deleted")])):
            step()
            wait_for(want)
    finally:
        query.stop()


def test_the_stream_can_be_read_as_a_table(spark, tmp_path):
    root = tmp_path / "src"
    root.mkdir()
    for i in range(5):
        (root / f"T{i}.java").write_text(f"class T{i} {{}}")
    rows = V.drain(source_changes(spark, str(root), str(tmp_path / "m")), "watched", "append")
    assert {(os.path.basename(r["path"]), r["state"]) for r in rows.collect()} == {(f"T{i}.java", "added") for i in range(5)}
