"""Stable tables in the folder that driver and executors share, and versions of a graph on disk."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .graph import Graph


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; one of our own only where none is set and all runs on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="codeweft-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def pinned(df: DataFrame, name: str) -> DataFrame:
    """Write and read back: cuts the lineage of loops and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of edges that a task of a step over all edges takes.
ROWS_A_PART = 1 << 17


def parts_for(spark: SparkSession, rows: int) -> int:
    """Partitions for a step over ``rows`` rows of edges, so that what a task holds doesn't grow with the table."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_A_PART))


TABLES = ("nodes", "edges", "methods", "types")


def save_version(graph: Graph, root: str, version: int) -> str:
    """Write an immutable version; edges are partitioned by type, so that type filters prune files."""
    path = f"{root}/v={version}"
    for name in TABLES:
        df = getattr(graph, name)
        if df is not None:
            writer = df.write.mode("errorifexists")
            (writer.partitionBy("type") if name == "edges" else writer).parquet(f"{path}/{name}")
    return path


def load_version(spark: SparkSession, path: str, tables=("nodes", "edges")) -> Graph:
    found = {t: spark.read.parquet(f"{path}/{t}") for t in tables}
    return Graph(**found)


def store_location(codebase: str | None, default: str = "codeweft-store") -> str:
    """Where the graph of a code base is kept: beside it, or the default."""
    return f"{codebase.rstrip('/')}/.codeweft" if codebase else default
