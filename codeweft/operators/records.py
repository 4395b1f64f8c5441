"""What a graph's store keeps beside the graph: embeddings, labels of communities, hyperedges, questions with their answers.

Lists of members are kept as an incidence table, a row for each member, so a list of any length is no single
row, a node's lists are found by its id, and deleting a node takes it out of all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..changelog import Commit, GraphLog

#: Tables that name nodes, by the column that does.
NODE_COLUMNS = {"embeddings": "node_id", "members": "node_id", "answer_nodes": "node_id"}


def save_embeddings(log: GraphLog, vectors: DataFrame) -> Commit:
    """Upsert (node_id, fqn, kind, vector) by node; null and empty vectors are skipped."""
    return log.upsert("embeddings", vectors.where(F.size("vector") > 0).dropDuplicates(["node_id"]))


def save_labels(log: GraphLog, labels: DataFrame) -> Commit:
    """Upsert (community_id, label)."""
    return log.upsert("labels", labels.dropDuplicates(["community_id"]))


def _lists(log: GraphLog, rows: DataFrame, heads: str, members: str, owner: str) -> Commit:
    """Upsert rows (id, ..., node_ids) and their members; members that a row had before and has no more go."""
    rows = rows.dropDuplicates(["id"])
    each = rows.select(F.col("id").alias(owner), F.posexplode("node_ids").alias("place", "node_id")).groupBy(owner, "node_id").agg(F.min("place").alias("place"))
    now, old = each.withColumn("gone", F.lit(False)), log.table(members)
    if old is not None:
        left = old.join(rows.select(F.col("id").alias(owner)), owner, "left_semi").join(each.select(owner, "node_id"), [owner, "node_id"], "left_anti")
        now = now.unionByName(left.withColumn("gone", F.lit(True)).select(*now.columns))
    return log.append({heads: rows.drop("node_ids").withColumn("gone", F.lit(False)), members: now})


def save_hyperedges(log: GraphLog, hyperedges: DataFrame) -> Commit:
    """Upsert (id, label, relation, provenance, confidence_score, node_ids)."""
    return _lists(log, hyperedges, "hyperedges", "members", "hyperedge_id")


def save_answers(log: GraphLog, answers: DataFrame) -> Commit:
    """Upsert (id, question, answer, created_at, node_ids)."""
    return _lists(log, answers, "answers", "answer_nodes", "answer_id")


def _with_lists(heads: DataFrame, members: DataFrame, owner: str) -> DataFrame:
    lists = members.groupBy(F.col(owner).alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "node_id"))), lambda m: m["node_id"]).alias("node_ids"))
    return heads.join(lists, "id", "left").withColumn("node_ids", F.coalesce("node_ids", F.array().cast("array<string>")))


def hyperedges(log: GraphLog) -> DataFrame:
    """(id, label, relation, provenance, confidence_score, node_ids) as saved."""
    return _with_lists(log.table("hyperedges"), log.table("members"), "hyperedge_id")


def answers(log: GraphLog) -> DataFrame:
    """(id, question, answer, created_at, node_ids) as saved."""
    return _with_lists(log.table("answers"), log.table("answer_nodes"), "answer_id")


def lists_of(log: GraphLog, nodes: DataFrame) -> DataFrame:
    """(node_id, hyperedge_id) of ``nodes`` (node_id)."""
    return log.table("members").join(nodes, "node_id", "left_semi").select("node_id", "hyperedge_id")


def cascade(log: GraphLog, gone: DataFrame) -> dict[str, DataFrame]:
    """Tombstones in all tables that name one of the nodes that are ``gone`` (id)."""
    out = {}
    for name, column in NODE_COLUMNS.items():
        rows = log.table(name)
        if rows is not None:
            out[name] = rows.join(gone.select(F.col("id").alias(column)), column, "left_semi").select(*rows.columns).withColumn("gone", F.lit(True))
    return out
