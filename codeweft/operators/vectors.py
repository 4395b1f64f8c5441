"""Similarity edges and vector search; the embedder is a plug-in."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import cosine
from ..storage import pinned

#: Vectors of a block, about, and rows of a block that are scored at once.
BLOCK_ROWS, SLICE_ROWS = 4_096, 512
#: Pivots at most: they are known to every task (1,024 vectors), and there is one for each block up to that.
PIVOTS = 1_024
#: Rounding of angles, allowed for in every bound.
SLACK = 1e-6


def _units(column: pd.Series) -> np.ndarray:
    x = np.array(column.tolist(), np.float64).reshape(len(column), -1)
    norm = np.sqrt((x * x).sum(axis=1))
    return x / np.where(norm > 0, norm, 1)[:, None]


@dataclass(frozen=True)
class AngleIndex:
    """rows (fqn, vector, block) and blocks (block, pivot, least, most): the angles between a block's vectors and its pivot."""

    rows: DataFrame
    blocks: DataFrame
    pivots: np.ndarray

    def pairs(self, threshold: float) -> DataFrame:
        """(x, y) of blocks, x <= y, between which two vectors may have a cosine of ``threshold``.

        Vectors at angles a and b from pivots that are t apart are t - a - b apart at least; from one pivot, the
        difference of a and b at least.
        """
        spark = self.rows.sparkSession
        if threshold <= 0 or not len(self.pivots):
            met = [(p, q, 0.0) for p in range(len(self.pivots)) for q in range(p, len(self.pivots))]
            wide = np.pi
        else:
            wide = float(np.arccos(min(1.0, threshold))) + SLACK
            reach = np.full(len(self.pivots), -np.inf)
            for r in self.blocks.groupBy("pivot").agg(F.max("most").alias("most")).collect():  # a row for each pivot
                reach[r["pivot"]] = r["most"]
            apart = np.arccos(np.clip(self.pivots @ self.pivots.T, -1, 1))
            near = np.argwhere(apart - reach[:, None] - reach[None, :] <= wide)
            met = [(int(p), int(q), float(apart[p, q])) for p, q in near if p <= q]
        pivots = spark.createDataFrame(met, "p long, q long, apart double")
        left = self.blocks.select(F.col("pivot").alias("p"), F.col("block").alias("x0"), F.col("least").alias("x_least"), F.col("most").alias("x_most"))
        right = self.blocks.select(F.col("pivot").alias("q"), F.col("block").alias("y0"), F.col("least").alias("y_least"), F.col("most").alias("y_most"))
        both = pivots.join(left, "p").join(right, "q")
        ring = F.when(F.col("p") == F.col("q"), F.greatest(F.col("x_least") - F.col("y_most"), F.col("y_least") - F.col("x_most"))).otherwise(F.lit(0.0))
        bound = F.greatest(F.col("apart") - F.col("x_most") - F.col("y_most"), ring)
        near = both.where((bound <= wide) if threshold > 0 else F.lit(True))
        return near.select(F.least("x0", "y0").alias("x"), F.greatest("x0", "y0").alias("y")).distinct()


def angle_index(vectors: DataFrame, block_rows: int = BLOCK_ROWS) -> AngleIndex:
    """Blocks of vectors (fqn, vector) that are at like angles from the same pivot; empty and null vectors are left out.

    Pivots are rows picked by a hash. A pivot's vectors are cut into rings of about ``block_rows`` by their angle,
    so a crowd around one pivot is many blocks and not one.
    """
    rows = vectors.where(F.size("vector") > 0).select("fqn", "vector")
    wanted = max(1, min(PIVOTS, -(-rows.count() // block_rows)))
    picked = rows.select("vector", F.xxhash64("fqn").alias("h")).orderBy("h").limit(wanted).toPandas()
    pivots = _units(picked["vector"]) if len(picked) else np.zeros((0, 0))

    def place(batches):
        for data in batches:
            cosines = np.clip(_units(data["vector"]) @ pivots.T, -1, 1)
            best = cosines.argmax(axis=1)
            yield data.assign(pivot=best, angle=np.arccos(cosines[np.arange(len(data)), best]))

    kind = rows.schema["vector"].dataType.simpleString()
    placed = pinned(rows.mapInPandas(place, f"fqn string, vector {kind}, pivot long, angle double"), "angles")
    # Rings by a histogram of angles: steps of a degree, split by a hash where one step has too many.
    step = F.floor(F.degrees("angle")).cast("long")
    counts = placed.groupBy("pivot", step.alias("step")).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("pivot").orderBy("step"))  # at most 181 steps of a pivot
    rings = counts.select("pivot", "step", F.ceil(F.col("n") / block_rows).alias("parts"), F.when(F.col("n") < block_rows, F.floor((before - F.col("n")) / block_rows)).otherwise(F.lit(-1) - F.col("step")).alias("ring"))
    salted = placed.withColumn("step", step).join(F.broadcast(rings), ["pivot", "step"]).withColumn("salt", F.pmod(F.xxhash64("fqn", F.lit(5)), F.col("parts")))
    dealt = pinned(salted.select("fqn", "vector", "pivot", "angle", F.xxhash64("pivot", "ring", "salt").alias("block")), "angle-blocks")
    blocks = dealt.groupBy("block", "pivot").agg(F.min("angle").alias("least"), F.max("angle").alias("most"))
    return AngleIndex(dealt.select("fqn", "vector", "block"), pinned(blocks, "angle-table"), pivots)


def similar_pairs(vectors: DataFrame, threshold: float = 0.8, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b, score) of all pairs of rows (fqn, vector) with a < b at or above the threshold, exactly.

    Only pairs of blocks that can hold such a pair are multiplied, some rows at a time, each in a task of
    its own; only pairs over the threshold leave it. Zero vectors have a cosine of 0 with all.
    """
    index = angle_index(vectors, block_rows)
    pairs = index.pairs(threshold)
    ends = pairs.select("x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    spread = index.rows.join(ends, "block")

    def run(data: pd.DataFrame) -> pd.DataFrame:
        unit = _units(data["vector"])
        names, first = data["fqn"].to_numpy(), (data["block"] == data["x"]).to_numpy()
        same = data["x"].iloc[0] == data["y"].iloc[0]
        left, right = (np.arange(len(data)),) * 2 if same else (np.flatnonzero(first), np.flatnonzero(~first))
        found = []
        for lo in range(0, len(left), SLICE_ROWS):
            scores = unit[left[lo : lo + SLICE_ROWS]] @ unit[right].T
            i, j = np.nonzero(scores >= threshold)
            found.append((left[lo + i], right[j], scores[i, j]))
        i, j, s = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        a, b = names[i], names[j]
        keep = a < b if same else a != b
        low = np.where(a < b, a, b)[keep]
        return pd.DataFrame({"a": low, "b": np.where(a < b, b, a)[keep], "score": s[keep]})

    return spread.groupBy("x", "y").applyInPandas(run, "a string, b string, score double").groupBy("a", "b").agg(F.max("score").alias("score"))


def strongest(pairs: DataFrame, limit: int = 50) -> DataFrame:
    return pairs.orderBy(F.col("score").desc(), "a", "b").limit(limit)


def similarity_edges(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.lit("SEMANTICALLY_SIMILAR").alias("type"), F.concat(F.lit("class:"), "a").alias("from_id"), F.concat(F.lit("class:"), "b").alias("to_id"), F.col("score").alias("weight"), F.lit("INFERRED").alias("provenance"), F.col("score").alias("confidence_score"))


def encode_vectors(vectors: DataFrame, column: str = "vector") -> DataFrame:
    """Vectors as little-endian 32-bit floats, for stores that keep blobs."""
    blob = F.pandas_udf(lambda xs: xs.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes()), "binary")
    return vectors.withColumn(column, blob(column))


def decode_vectors(vectors: DataFrame, column: str = "vector") -> DataFrame:
    floats = F.pandas_udf(lambda xs: xs.map(lambda x: None if x is None else np.frombuffer(x, "<f4")), "array<float>")
    return vectors.withColumn(column, floats(column))


def alike_shapes(types: DataFrame, block: int = 1_000) -> DataFrame:
    """Pairs (a, b) of one kind and number of methods, for when there are no vectors.

    The pairs are many more than the types, so large groups are cut into blocks of about ``block`` types, whose
    pairs of blocks are dealt over all tasks.
    """
    t = types.select("fqn", "kind", "method_count")
    sizes = t.groupBy("kind", "method_count").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    own = t.join(sizes, ["kind", "method_count"]).withColumn("own", F.pmod(F.xxhash64("fqn"), F.col("blocks")))
    each = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    key = ["kind", "method_count", "p", "q"]
    # A number that is asked for stays: the rows are few, so they would be put together into a task or two.
    dealt = each.select("fqn", "kind", "method_count", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own").repartition(int(t.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)
    pairs = dealt.alias("a").join(dealt.alias("b"), key).where((F.col("a.fqn") < F.col("b.fqn")) & ((F.col("p") == F.col("q")) | (F.col("a.own") != F.col("b.own"))))
    return pairs.select(F.col("a.fqn").alias("a"), F.col("b.fqn").alias("b"), F.lit(0.5).alias("weight"), F.lit(0.65).alias("confidence_score"))


def best_scores(vectors: DataFrame, query: list[float], least: float = 0.65) -> DataFrame:
    """(fqn, score): the best cosine with the query of each type's vectors, at ``least`` or above."""
    wanted = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.where(F.size("vector") > 0).select("fqn", cosine(F.col("vector"), wanted).alias("score")).where(F.col("score") >= least)
    return scored.groupBy("fqn").agg(F.max("score").alias("score"))


def search(vectors: DataFrame, query: list[float], limit: int = 5, least: float = 0.65) -> DataFrame:
    """The ``limit`` types with the best scores, in order."""
    return best_scores(vectors, query, least).orderBy(F.col("score").desc(), "fqn").limit(max(1, limit))


def hashing_vectors(texts: DataFrame, width: int = 64) -> DataFrame:
    """Offline embedder: (id, text) to signed hashed word counts, unit length; empty text has no vector."""
    words = texts.select("id", F.explode(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")).alias("word"))
    slot = F.pmod(F.xxhash64("word"), F.lit(width))
    sums = words.groupBy("id", slot.alias("slot")).agg(F.sum(F.when(F.xxhash64("word", F.lit(1)) % 2 == 0, 1.0).otherwise(-1.0)).alias("x"))
    filled = sums.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "x"))).alias("m"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    vector = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long")), lambda i: (F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.greatest("norm", F.lit(1e-12))).cast("float"))
    return filled.select("id", vector.alias("vector"))


def embed(methods: DataFrame, embedder: Callable[[DataFrame], DataFrame] = hashing_vectors) -> DataFrame:
    """Vectors of method bodies and of each type's joined bodies: (node_id, fqn, kind, vector)."""
    bodies = methods.where(F.trim(F.coalesce("raw_body", F.lit(""))) != "")
    each = bodies.select(F.concat(F.lit("method:"), "fqn", F.lit("#"), "signature").alias("id"), F.col("raw_body").alias("text"))
    whole = bodies.groupBy("fqn").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("signature", "raw_body"))), lambda m: m["raw_body"]), "\n").alias("text")).select(F.concat(F.lit("class:"), "fqn").alias("id"), "text")
    made = embedder(each.union(whole))
    return made.select(F.col("id").alias("node_id"), F.regexp_extract("id", "^[a-z]+:([^#]*)", 1).alias("fqn"), F.when(F.col("id").startswith("class:"), "CLASS").otherwise("METHOD").alias("kind"), "vector")
