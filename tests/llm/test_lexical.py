"""Ranked lexical search against plain scoring of every document."""

import collections
import math
import re

import numpy as np

from codeweft.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def plain(docs, items, k=10):
    """(item, rank, doc, score), every document scored."""
    counts = [(i, collections.Counter(TERM.findall((t or "").translate(UPPER)))) for i, t in docs]
    n_docs, words = sum(1 for _, c in counts if c), sum(sum(c.values()) for _, c in counts)
    df = collections.Counter(w for _, c in counts for w in c)
    asked = collections.defaultdict(set)
    for i, t in items:
        asked[i] |= set(TERM.findall((t or "").translate(UPPER)))
    out = []
    for item, terms in asked.items():
        scored = []
        for doc, c in counts:
            m = 10 + 90 * sum(c.values()) * n_docs // max(1, words)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in terms if w in c)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k])]
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def test_query_equals_plain_scoring(spark):
    sf = "/root/testdata/sf0.001"
    rows = [[tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(i, "text").collect()] for t, i in (("documents", "doc_id"), ("benchmark", "item_id"))]
    assert got(lexical.op13_lexical(spark, sf)) == plain(*rows)


def test_small_shards_and_blocks_give_the_same(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    assert got(lexical.search(docs, items, block_terms=300, shard_bytes=20_000)) == got(lexical.search(docs, items))


def test_ties_repeats_nulls_and_clashing_columns(spark, odd, none):
    items = spark.createDataFrame([(1, "the cat", "x"), (1, "ONE one", "x"), (2, None, "x"), (3, " .,", "x"), (None, "mit Äpfel", "x"), (4, "the " * 5000 + "wörter", "x")], "item_id long, text string, doc_id string")
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    asked = [(r["item_id"], r["text"]) for r in items.collect()]
    assert got(lexical.search(odd.withColumn("item_id", odd["doc_id"]), items)) == plain(rows, asked)
    assert lexical.search(none, items).collect() == [] == lexical.search(odd, items.limit(0)).collect()
    many = spark.createDataFrame([(i % 9, "the same text") for i in range(40)], "doc_id long, text string")
    assert got(lexical.search(many, items, k=3)) == plain([(i % 9, "the same text") for i in range(40)], asked, 3)


def test_the_threshold_stops_early():
    rng = np.random.default_rng(3)
    n_docs = 20_000
    n = rng.integers(20, 2000, n_docs)
    held = np.sort(rng.permutation(n_docs)[:15_000])
    starts = np.searchsorted(held, np.arange(n_docs + 1))
    row = {"ids": list(range(n_docs)), "n": n, "starts": starts, "term": np.zeros(len(held), int), "tf": rng.integers(1, 30, len(held))}
    shard = lexical.Shard(row, 1, n_docs, int(n.sum()))
    docs, scores, read = shard.search(np.array([0]), np.array([500]), 10, 0)
    assert sorted(scores)[-10:] == sorted(shard.impacts * 500)[-10:] and read < 100
    assert shard.search(np.array([0]), np.array([500]), 10, int(scores.max()) + 1)[2] == 0
