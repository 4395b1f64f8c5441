"""Helpers that the operators share: the shared folder, stable tables and plain text expressions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that a writer of a pinned table holds before they go to disk, and so a row group that a reader holds.
ROW_GROUP = 16 << 20
#: Tables of fewer rows are read as they lie.
FEW_ROWS = 2_000
#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set and all runs on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="codeweft-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def pinned(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` of a table just read; dealt to more tasks if they lie in so few row groups that one task would have the work of several."""
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]  # from the files' footers
    total, context = sum(sizes), rows.sparkSession.sparkContext
    if total <= FEW_ROWS or max(sizes) * context.defaultParallelism <= 2 * total:
        return rows
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // 10_000))
    return rows.withColumn("_at", F.monotonically_increasing_id()).repartition(n, "_at").drop("_at")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


def with_texts(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` and the texts for ``texts_of``: within the column ``row`` if that is kept, so that no text travels twice, else beside it."""
    if "row" in keep:
        return docs.select(*keep)
    return docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_raw"))


def texts_of(batch, text_col: str = "text"):
    """The texts of a batch of ``with_texts`` as an Arrow array without nulls."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if "_raw" in batch.schema.names:
        return batch.column("_raw")
    return pc.fill_null(pc.struct_field(batch.column("row"), text_col).cast(pa.large_string()), "").cast(pa.large_binary())


def map_columns(df: DataFrame, keep: list[str], fields: str, fn) -> DataFrame:
    """``keep`` as it is, and the columns that ``fn(batch)`` gives: one list or array for each of ``fields``.

    Arrow carries the kept columns, so ids with nulls stay whole.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    added = StructType.fromDDL(fields)
    schema = StructType([*(df.schema[k] for k in keep), *added])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            new = [pa.array(x, type=arrow.field(len(keep) + i).type) for i, x in enumerate(fn(batch))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).cast(arrow.field(i).type) for i, k in enumerate(keep)), *new], schema=arrow)

    return df.mapInArrow(run, schema)
