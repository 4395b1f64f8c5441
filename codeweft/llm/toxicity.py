"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct hashed words, their first bytes, word pairs and pairs over one skipped word of a text. The
learner keeps a rate per coordinate and an L1 penalty, so that few weights are not zero; these are
collected (at most ``2 ** bits``) and sent to every task, which scores whole texts in numpy.

The learner sees at most ``max_rows`` labelled rows of each class (the first by a hash of the id), in
one task. It reads them ``epochs`` times, and leaves out features that fewer than ``min_rows`` of them
have. Everything else covers all rows.

Results for odd input: null text is empty and scores the bias; rows with a null label or id are not
learned from, and a null id counts as held out; of documents that share an id one (the least text) is
learned from, so repeats don't outgrow ``max_rows``; repeated rows score alike; where the labels or the
documents found for them are not of both classes, the score is the share of toxic labels (0 without
labels); a text of any length is one row of a task, which holds some tens of its bytes for each byte of at
most ``CHUNK_BYTES`` or of the text if longer; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, map_columns, table, texts_of, with_texts
from .hashing import ALNUM, chunks, column_bytes, pair, tokens

BITS = 20
CHUNK_BYTES = 1 << 20
#: Times that the sample is read.
EPOCHS = 12
#: Longer words also count by their first bytes, so that a rare form is near the forms that were learned.
PREFIXES = (4, 5, 6, 7, 8)


def feature_slots(raw: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Row and slot of every n-gram and skip-gram, repeats included."""
    words, counts, *heads = tokens(raw, offsets, ALNUM, PREFIXES)
    row = np.repeat(np.arange(len(counts)), counts)
    shift = np.uint64(64 - bits)
    with np.errstate(over="ignore"):
        kinds = [(row, words >> shift), *((row[h != 0], pair(h[h != 0], h[h != 0], 10 + n) >> shift) for n, h in zip(PREFIXES, heads))]
        for gap, salt in ((1, 1), (2, 2)):
            same = row[gap:] == row[:-gap] if len(row) > gap else np.zeros(0, bool)
            kinds.append((row[gap:][same], pair(words[:-gap][same], words[gap:][same], salt) >> shift) if len(same) else (row[:0], words[:0]))
    return np.concatenate([k[0] for k in kinds]), np.concatenate([k[1] for k in kinds]).astype(np.int64)


@dataclass
class Ftrl:
    """FTRL-proximal with a rate per coordinate."""

    size: int
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 3.5
    l2: float = 1.0

    def __post_init__(self):
        self.z, self.n = np.zeros(self.size + 1), np.zeros(self.size + 1)

    def weights(self, at) -> np.ndarray:
        z, penalty = self.z[at], np.full(np.shape(at), self.l1)
        penalty[np.asarray(at) == self.size] = 0.0
        return np.where(np.abs(z) <= penalty, 0.0, (np.sign(z) * penalty - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: float) -> None:
        """``at``: distinct slots; the last slot is the bias."""
        at = np.append(at, self.size)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 10_000, epochs: int = EPOCHS, bits: int = BITS, min_rows: int = 4, seed: int = 3) -> tuple[np.ndarray, np.ndarray, float]:
    """Slots, weights and bias, from the texts of the rows that ``labels`` (doc_id, label) has."""
    pick = F.xxhash64(F.lit(seed), F.col("doc_id"))
    counts = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = [labels.where(F.col("label") == label).select("doc_id", "label", pick.alias("pick")).orderBy("pick", "doc_id").limit(max_rows) for label in counts]
    total = sum(counts.values())
    rate = counts.get(1, 0) / total if total else 0.0
    share = np.zeros(0, np.int64), np.zeros(0), float(np.log((rate + 1e-9) / (1 - rate + 1e-9)))
    if len(counts) < 2:
        return share
    # At most max_rows of each of two labels, so the ids may be broadcast and no text is shuffled to find them.
    some = F.broadcast(chosen[0].union(chosen[1]).distinct())
    found = docs.select("doc_id", "text").join(some, "doc_id").groupBy("doc_id", "label", "pick").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    sample = found.select("label", "pick", F.col("text").cast("binary").alias("raw"))

    def slots(batch):
        raw, offsets = column_bytes(batch.column("raw"))
        out = []
        for lo, hi in chunks(offsets, CHUNK_BYTES):
            row, slot = feature_slots(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], bits)
            both = np.unique(row * (1 << bits) + slot)
            edges = np.searchsorted(both, np.arange(hi - lo + 1) << bits)
            out += [(both[a:b] & ((1 << bits) - 1)).astype(np.int32) for a, b in zip(edges[:-1], edges[1:])]
        return [out]

    def fit(batches):
        import pyarrow as pa

        rows, seen = [], np.zeros(1 << bits, np.int32)
        for batch in batches:
            values, ends = batch.column("slots").flatten().to_numpy(), np.cumsum(batch.column("slots").value_lengths().to_numpy())
            for a, b, label in zip(np.append(0, ends[:-1]), ends, batch.column("label").to_pylist()):
                rows.append((values[a:b].copy(), float(label)))
                seen[values[a:b]] += 1  # a row's slots are distinct
        slot, weight = np.zeros(0, np.int64), np.zeros(0)
        if len({label for _, label in rows}) == 2:
            for i, (at, label) in enumerate(rows):
                rows[i] = at[seen[at] >= min_rows], label
            model = Ftrl(1 << bits)
            for _ in range(epochs):
                for at, label in rows:
                    model.learn(at, label)
            w = model.weights(np.arange(model.size + 1))
            keep = np.flatnonzero(w[:-1])
            slot, weight = np.append(keep, -1), np.append(w[keep], w[-1])
        yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int64()), pa.array(weight, pa.float64())], names=["slot", "weight"])

    # One task reads the sample in order; it keeps the slots of its rows, of which there are max_rows of a class at most.
    found = map_columns(sample, ["label", "pick"], "slots array<int>", slots).repartition(1).sortWithinPartitions("pick", "label").mapInArrow(fit, "slot long, weight double").toPandas()
    if found.empty:
        return share
    bias = float(found.loc[found["slot"] < 0, "weight"].iloc[0])
    found = found[found["slot"] >= 0]
    return found["slot"].to_numpy(), found["weight"].to_numpy(), bias


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], keep: list[str], text_col: str = "text", bits: int = BITS) -> DataFrame:
    """``keep`` and toxic_score of every row."""
    at, weights, bias = model
    sent = docs.sparkSession.sparkContext.broadcast((np.asarray(at), np.asarray(weights, np.float32)))

    def run(batch):
        slots, values = sent.value
        dense = np.zeros(1 << bits, np.float32)
        dense[slots] = values
        raw, offsets = column_bytes(texts_of(batch, text_col))
        out = np.full(batch.num_rows, bias)
        for lo, hi in chunks(offsets, CHUNK_BYTES):
            row, slot = feature_slots(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], bits)
            used = dense[slot] != 0
            both = np.unique((row[used] << bits) + slot[used])
            np.add.at(out, lo + (both >> bits), dense[both & ((1 << bits) - 1)])
        return [1 / (1 + np.exp(-np.clip(out, -35, 35)))]

    return map_columns(with_texts(docs, keep, text_col), keep, "toxic_score double", run)


def known_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, label) to learn from: toxic 0 or 1, and crc32 of the id modulo 3 not 1."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("label"))
    return known.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (fold(F.col("doc_id"), 3) != 1))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, known_labels(table(spark, sf_dir, "labels")))
    rows = docs.select("doc_id", "text").withColumn("held_out", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(True)))
    return score(rows, model, ["doc_id", "held_out"]).select("doc_id", "held_out", F.col("toxic_score").alias("score"), F.when(F.col("toxic_score") >= 0.7, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, model, threshold: float = 0.7) -> DataFrame:
    """Rows of ``docs`` that score under the threshold; whole rows travel as one column, so no name can clash."""
    boxed = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return score(boxed, model, ["row"]).where(F.col("toxic_score") < threshold).select("row.*")
