"""Graph mutations as a stream: each micro-batch makes one new version, written whole or as changes to a log."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..changelog import KEYS, GraphLog, difference
from ..functions.scalars import class_fqn_from_method_id, class_id, method_id, signature_from_method_id
from ..graph import Graph
from ..operators import mutate as M
from ..operators import records
from ..operators.sieve import sieve
from ..storage import load_version, pinned, shared_dir

SPLIT, SIGNATURE, MIGRATED = "NODE_SPLIT", "SIGNATURE_CHANGED", "NODE_MIGRATED"


def last_events(events: DataFrame) -> DataFrame:
    """The last event of each kind and node, by time."""
    rest = [c for c in events.columns if c not in ("kind", "node_id")]
    return events.groupBy("kind", "node_id").agg(F.max_by(F.struct(*rest), "timestamp").alias("e")).select("kind", "node_id", "e.*")


def apply_events(graph: Graph, events: DataFrame) -> Graph:
    """Signature changes, then migrations, then splits (which delete the old node); last event wins.

    A replay of the same events gives the same graph.
    """
    last = last_events(events)
    changed = last.where(F.col("kind") == SIGNATURE).select(F.col("node_id").alias("old_id"), method_id(class_fqn_from_method_id(F.col("node_id")), F.col("new_signature")).alias("new_id"))
    moved = last.where(F.col("kind") == MIGRATED).select(F.col("node_id").alias("id"), F.lit("MIGRATED").alias("new_status"))
    gone = last.where(F.col("kind") == SPLIT).select(F.col("node_id").alias("id"))
    after = M.delete_nodes(M.set_status(M.rename_methods(graph, changed), moved), gone)
    if graph.methods is not None:
        to = changed.select("old_id", signature_from_method_id(F.col("new_id")).alias("_to"))
        own = method_id(F.col("fqn"), F.col("signature"))
        methods = graph.methods.withColumn("_id", own).join(to.withColumnRenamed("old_id", "_id"), "_id", "left").withColumn("signature", F.coalesce("_to", "signature")).select(*graph.methods.columns)
        after = after.with_(methods=M.without(methods.dropDuplicates(["fqn", "signature"]), own, gone))
    if graph.types is not None:
        after = after.with_(types=M.without(graph.types, class_id(F.col("fqn")), gone))
    return after


def mutate_stream(events: DataFrame, start: str, root: str, checkpoint: str) -> StreamingQuery:
    """Run a stream of events over the version at ``start``; batch n writes ``root``/v=n from the one before it."""

    def batch(rows: DataFrame, n: int) -> None:
        spark = rows.sparkSession
        before = load_version(spark, start if n == 0 else f"{root}/v={n - 1}")
        after = apply_events(before, rows)
        for name in ("nodes", "edges"):  # a replayed batch overwrites its own version
            getattr(after, name).write.mode("overwrite").parquet(f"{root}/v={n}/{name}")

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def touched(graph: Graph, ids: DataFrame) -> Graph:
    """The part of the graph that events on ``ids`` (id, each once) can change: these nodes, their edges, methods and types.

    Only what may be touched is moved to be joined.
    """
    some = sieve(ids, "id")

    def of(rows: DataFrame, id_) -> DataFrame:
        return some.marked(rows.withColumn("_own", id_), "_maybe", "_own").where("_maybe").join(ids.select(F.col("id").alias("_own")), "_own", "left_semi").select(*rows.columns)

    edges = some.marked(some.marked(graph.edges, "_from", "from_id"), "_to", "to_id").where("_from or _to").drop("_from", "_to")
    for end in ("from_id", "to_id"):
        edges = edges.join(ids.select(F.col("id").alias(end), F.lit(True).alias(f"_{end}")), end, "left")
    edges = edges.where("_from_id or _to_id").select(*graph.edges.columns)
    methods = graph.methods and of(graph.methods, method_id(F.col("fqn"), F.col("signature")))
    types = graph.types and of(graph.types, class_id(F.col("fqn")))
    return Graph(of(graph.nodes, F.col("id")), edges, methods, types)


def mutate_log(events: DataFrame, log: GraphLog, checkpoint: str) -> StreamingQuery:
    """Run a stream of events (kind, node_id, new_signature, timestamp) over a log; each batch appends what it changes.

    An event that is not after the last one applied to its node and kind is late or a repeat and changes
    nothing, in whatever batch it comes; a batch that is run again appends nothing.
    """

    def batch(rows: DataFrame, n: int) -> None:
        if 0 <= n <= log.commit().batch:
            return
        last = pinned(last_events(rows), "events")
        known = log.applied().select("kind", "node_id", F.col("timestamp").alias("_seen"))
        fresh = pinned(last.join(known, ["kind", "node_id"], "left").where(F.col("_seen").isNull() | (F.col("timestamp") > F.col("_seen"))).drop("_seen"), "events")
        renamed = method_id(class_fqn_from_method_id(F.col("node_id")), F.col("new_signature"))
        ids = fresh.select(F.col("node_id").alias("id")).union(fresh.where(F.col("kind") == SIGNATURE).select(renamed))
        before = touched(log.graph(), pinned(ids.distinct(), "events"))
        before = before.with_(nodes=pinned(before.nodes, "touched"), edges=pinned(before.edges, "touched"))
        after = apply_events(before, fresh)
        names = [t for t in ("nodes", "edges", "methods", "types") if getattr(before, t) is not None]
        changes = {t: difference(getattr(before, t), getattr(after, t), KEYS[t]) for t in names}
        changes |= records.cascade(log, changes["nodes"].where("gone").select("id"))
        log.append({**changes, "applied": fresh.select("kind", "node_id", F.col("timestamp").cast("timestamp").alias("timestamp"), F.lit(False).alias("gone"))}, n)

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what is available and give its final rows, from the shared folder."""
    spark = stream.sparkSession
    place = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    stream.writeStream.outputMode(mode).foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{place}/rows")).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/rows")
