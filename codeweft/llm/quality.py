"""Quality by hierarchical empirical Bayes.

A document's evidence is a naive-Bayes log ratio over binned surface features, counted on labelled
rows (those whose crc32(id) modulo 3 is not 1). The evidence of all documents, as probabilities, is
summed by path and host. A path's rate is shrunk toward its host's, and a host's toward the global
rate, each with a strength that the spread of the rates between sites gives (method of moments), so
sparse sites fall back on their parents. A document's posterior adds its evidence to its path's log odds.

The default host is ``source`` and the default path ``source`` and ``lang``; both are parameters.

Results for odd input: null text is empty and has the features of an empty text; null hosts and
paths are sites of their own; repeated rows score alike; labels that are null or not 0 or 1, or
without a document, are not used; with one class only, or no label, evidence is 0 and every
document is kept; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dealt, fold, map_columns, pinned, table, texts_of, with_texts
from .hashing import NON_SPACE, chunks, column_bytes, tokens

CHUNK_BYTES = 1 << 20
#: Upper edges of each feature's bins; values above the last edge are a bin of their own.
EDGES = {
    "rare_marks": (0.0, 0.004, 0.02, 0.06, 0.15, 0.25),
    "upper": (0.005, 0.03, 0.06, 0.12, 0.25, 0.5),
    "digits": (0.0, 0.01, 0.05, 0.15, 0.4),
    "repeated_next": (0.0, 0.01, 0.03, 0.08, 0.2, 0.5),
    "distinct_words": (0.02, 0.1, 0.25, 0.4, 0.55, 0.7, 0.9),
    "word_bytes": (2.0, 3.0, 4.5, 6.0, 8.0, 12.0, 20.0),
    "words": (0.0, 5.0, 20.0, 80.0, 400.0, 2000.0),
}
_BYTES = np.arange(256)
#: ASCII marks that prose rarely has.
_MARKS = np.isin(_BYTES, [ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"])
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
#: Sites (paths) that are broadcast at most; more are joined by shuffle.
BROADCAST_SITES = 100_000


def _features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sizes = np.diff(offsets)
    total = np.maximum(1, sizes)

    def share(mask):
        return np.diff(np.concatenate([[0], np.cumsum(mask[raw])])[offsets]) / total

    words, counts = tokens(raw, offsets, NON_SPACE)
    n = np.maximum(1, counts)
    row = np.repeat(np.arange(len(sizes)), counts)
    again = np.zeros(len(row), bool)
    again[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
    order = np.lexsort((words, row))
    fresh = np.ones(len(row), bool)
    fresh[1:] = (words[order][1:] != words[order][:-1]) | (row[order][1:] != row[order][:-1])
    distinct = np.bincount(row[order][fresh], minlength=len(sizes)) / n
    distinct = distinct ** (1 / (1 + np.log10(np.maximum(1, counts / 300))))  # long texts repeat words
    non_space = np.diff(np.concatenate([[0], np.cumsum(NON_SPACE[raw])])[offsets])
    return np.stack([share(_MARKS), share(_UPPER), share(_DIGIT), np.bincount(row[again], minlength=len(sizes)) / n, distinct, non_space / n, counts], axis=1)


def feature_bins(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` and bins: the bin of each feature, numbered through all features."""
    widths = [len(e) + 1 for e in EDGES.values()]
    first = np.cumsum([0, *widths[:-1]])

    def run(batch):
        raw, offsets = column_bytes(texts_of(batch, text_col))
        out = np.zeros((batch.num_rows, len(EDGES)), np.int32)
        for lo, hi in chunks(offsets, CHUNK_BYTES):
            values = _features(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            for i, edges in enumerate(EDGES.values()):
                out[lo:hi, i] = first[i] + np.searchsorted(edges, values[:, i])
        return [list(out)]

    return map_columns(with_texts(docs, keep, text_col), keep, "bins array<int>", run)


def learn_evidence(bins: DataFrame, labels: DataFrame, smooth: float = 1.0) -> tuple[list[float], float]:
    """Log ratio of each bin, good against bad, and the share of good rows; from rows (doc_id, bins)."""
    n_bins = sum(len(e) + 1 for e in EDGES.values())
    known = labels.select("doc_id", F.col("quality").cast("int").alias("good")).where(F.col("doc_id").isNotNull() & F.col("good").isin(0, 1))
    rows = bins.where(fold(F.col("doc_id"), 3) != 1).join(known, "doc_id")
    counts = rows.select("good", F.explode("bins").alias("bin")).groupBy("good", "bin").agg(F.count(F.lit(1)).alias("n")).collect()
    n = {(r["good"], r["bin"]): r["n"] for r in counts}
    totals = [sum(c for (g, _), c in n.items() if g == good) / len(EDGES) for good in (0, 1)]
    if not all(totals):
        return [0.0] * n_bins, 1.0
    ratio = [math.log((n.get((1, b), 0) + smooth) / (totals[1] + smooth * 8)) - math.log((n.get((0, b), 0) + smooth) / (totals[0] + smooth * 8)) for b in range(n_bins)]
    return ratio, totals[1] / sum(totals)


def _logit(p: Column) -> Column:
    return F.log(p) - F.log(1 - p)


def _evidence(ratio: list[float]) -> Column:
    table_ = F.array(*[F.lit(float(x)) for x in ratio])
    return F.aggregate("bins", F.lit(0.0), lambda acc, b: acc + F.element_at(table_, b + 1))


def _clamped(p: Column) -> Column:
    return F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), p))


def _good(evidence: Column, prior: float) -> Column:
    """Probability of being good by the document's evidence and the prior alone."""
    p = min(max(prior, 1e-6), 1 - 1e-6)
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), evidence + math.log(p / (1 - p))))))


def site_posteriors(evidence: DataFrame, prior: float, least_strength: float = 5.0, most_strength: float = 1_000.0) -> DataFrame:
    """host, path, path_docs, path_good, strength, host_rate, path_rate from rows (host, path, evidence)."""
    p = _good(F.col("evidence"), prior)
    paths = evidence.groupBy("host", "path").agg(F.count(F.lit(1)).alias("path_docs"), F.sum(p).alias("path_good"))
    hosts = paths.groupBy("host").agg(F.sum("path_docs").alias("host_docs"), F.sum("path_good").alias("host_good"))

    def strength(rates: DataFrame, docs: str, rate: Column, parent: Column) -> Column:
        # Between-site variance: the spread of the rates less what their sizes alone would give.
        row = rates.agg(F.sum(F.col(docs) * (rate - parent) * (rate - parent)).alias("spread"), F.sum(parent * (1 - parent)).alias("noise"), F.sum(docs).alias("docs"), F.sum(F.col(docs) * parent * (1 - parent)).alias("var"))
        between = (F.col("spread") - F.col("noise")) / F.greatest(F.col("docs"), F.lit(1))
        value = F.when(between > 0, F.col("var") / F.greatest(F.col("docs"), F.lit(1)) / between - 1).otherwise(most_strength)
        return row.select(F.greatest(F.lit(least_strength), F.least(F.lit(most_strength), F.coalesce(value, F.lit(most_strength)))).alias("m"))

    overall = hosts.agg(F.coalesce(F.sum("host_good") / F.sum("host_docs"), F.lit(prior)).alias("p0")).first()["p0"]
    p0 = F.lit(min(max(float(overall), 1e-6), 1 - 1e-6))
    m0 = strength(hosts, "host_docs", F.col("host_good") / F.col("host_docs"), p0).first()["m"]
    hosts = hosts.withColumn("host_rate", (F.col("host_good") + F.lit(m0) * p0) / (F.col("host_docs") + F.lit(m0)))
    both = paths.alias("a").join(hosts.alias("b"), F.col("a.host").eqNullSafe(F.col("b.host"))).select("a.host", "path", "path_docs", "path_good", "host_rate")
    both = pinned(both, "quality-sites")
    m1 = strength(both, "path_docs", F.col("path_good") / F.col("path_docs"), _clamped(F.col("host_rate"))).first()["m"]
    return both.select("host", "path", "path_docs", "path_good", F.lit(float(m1)).alias("strength"), _clamped(F.col("host_rate")).alias("host_rate"), _clamped((F.col("path_good") + F.lit(m1) * F.col("host_rate")) / (F.col("path_docs") + F.lit(m1))).alias("path_rate"))


def quality(docs: DataFrame, labels: DataFrame, keep: list[str], host: Column | None = None, path: Column | None = None, text_col: str = "text") -> DataFrame:
    """``keep``, evidence, host_rate, path_rate and quality (the posterior of being good) of each row."""
    host = F.col("source") if host is None else host
    path = F.concat_ws("/", F.coalesce(F.col("source"), F.lit("\0")), F.coalesce(F.col("lang"), F.lit("\0"))) if path is None else path
    sited = docs.withColumns({"_host": host, "_path": path})
    # The kept columns are written beside the features, so that texts are read and cut into words once.
    rows = pinned(feature_bins(sited, list(dict.fromkeys([*keep, "doc_id", "_host", "_path"])), text_col), "quality-bins")
    ratio, prior = learn_evidence(rows, labels)
    sites = site_posteriors(rows.select(F.col("_host").alias("host"), F.col("_path").alias("path"), _evidence(ratio).alias("evidence")), prior)
    few = sites.count() <= BROADCAST_SITES
    judged = rows.withColumn("evidence", _evidence(ratio)).alias("d")
    joined = judged.join(F.broadcast(sites).alias("s") if few else sites.alias("s"), F.col("d._path").eqNullSafe(F.col("s.path")) & F.col("d._host").eqNullSafe(F.col("s.host")))
    # The path's rate without the document itself, whose evidence is added on its own.
    others = _clamped((F.col("s.path_good") - _good(F.col("d.evidence"), prior) + F.col("s.strength") * F.col("s.host_rate")) / (F.col("s.path_docs") - 1 + F.col("s.strength")))
    posterior = 1 / (1 + F.exp(-(F.col("d.evidence") + _logit(others))))
    return joined.select(*[F.col(f"d.{k}") for k in keep], F.col("d.evidence").alias("evidence"), "s.host_rate", "s.path_rate", posterior.alias("quality"))


def op6_quality(spark, sf_dir: str) -> DataFrame:
    found = quality(dealt(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")), table(spark, sf_dir, "labels"), ["doc_id"])
    return found.select("doc_id", "evidence", "host_rate", "path_rate", F.col("quality").alias("score"), F.when(F.col("quality") >= 0.5, 1).otherwise(0).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs`` that are good with at least the threshold; whole rows travel as one column, so no name can clash."""
    boxed = dealt(docs.select(F.struct(*docs.columns).alias("row"))).select("row", "row.doc_id", "row.text", "row.source", "row.lang")
    return quality(boxed, labels, ["row"]).where(F.col("quality") >= threshold).select("row.*")
