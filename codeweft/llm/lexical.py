"""Ranked lexical search by Fagin's threshold algorithm.

A term's weight falls with the number of documents that hold it; its impact in a document grows with its
occurrences and falls with the document's length. An item's score of a document is the sum of weight times
impact over the item's terms.

How it runs: items are taken in blocks of a bounded number of terms. One pass over the documents makes a
forward index of a block's terms in shards (documents of about ``SHARD_BYTES`` of text each), with the counts
that the weights need; counts are summed over all shards. Each shard then sorts the postings of every term by
impact. For each item it reads the lists of its terms round robin, a few entries of each at a time, looks up
every document met for the first time in the forward index for its whole score, and stops when the threshold
(the score of a document that would stand at the places reached in all lists) is strictly below the kth
score, so ties are never lost. A task carries its kth scores from shard to shard and hands on only its k best
of each item; a ranking over those gives the result. Nothing but a block's terms and their counts is sent to
all tasks, and work on shards is alike however many there are.

Terms are 64-bit hashes; two of them meet by chance with odds of the block's terms times the distinct terms
of the corpus in 2 ** 64.

Results for odd input: null and blank texts have no terms, as documents they count nowhere and as items have
no rows; rows that share an item id are one item with the terms of all; repeated documents are ranked each;
a null doc_id ranks after others of equal score; a null item_id is an item; ids must be integers; an empty
table gives an empty result; long texts are indexed whole; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import pinned, table
from .hashing import ALNUM, chunks, column_bytes, tokens

K = 10
SHARD_BYTES = 16 << 20
TOKEN_BYTES = 512 << 10
#: Terms of a block of items, about: 2 MB of hashes.
BLOCK_TERMS = 1 << 18
#: Entries of each list that are read at first; then twice as many each time.
FIRST_DEPTH = 16


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, terms: the distinct term hashes of each item."""
    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            raw, offsets = column_bytes(batch.column("raw"))
            hashes, counts = tokens(raw, offsets, ALNUM)[:2]
            ends = np.cumsum(counts)
            terms = [np.unique(hashes[e - n : e]).view(np.int64) for e, n in zip(ends, counts)]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(terms, pa.list_(pa.int64()))], names=["item_id", "terms"])

    found = rows.mapInArrow(run, "item_id long, terms array<long>").where(F.size("terms") > 0)
    return found.groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))


INDEX = "ids array<long>, n array<int>, starts array<int>, term array<int>, tf array<int>, held array<int>, df array<int>, docs long, words long"


def forward_index(docs: DataFrame, terms: np.ndarray, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """A row for each shard: its documents with their lengths, the places of ``terms`` that each holds and how often, and its counts."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw"))
    schema = StructType.fromDDL(INDEX)

    def shard(ids, raw, offsets):
        lengths, keys, times, first = [], [], [], 0
        for a, b in chunks(offsets, TOKEN_BYTES):
            hashes, n = tokens(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], ALNUM)[:2]
            at = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
            hit = np.flatnonzero(terms[at] == hashes)
            doc = np.repeat(np.arange(a, b), n)[hit]
            key, tf = np.unique(doc * len(terms) + at[hit], return_counts=True)
            lengths.append(n)
            keys.append(key)
            times.append(tf)
        n, key, tf = (np.concatenate(x) for x in (lengths, keys, times))
        doc, term = np.divmod(key, len(terms))
        held, df = np.unique(term, return_counts=True)
        starts = np.searchsorted(doc, np.arange(len(ids) + 1))
        return [ids.to_pylist(), n, starts, term, tf, held, df, int((n > 0).sum()), int(n.sum())]

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            raw, offsets = column_bytes(batch.column("raw"))
            for lo, hi in chunks(offsets, shard_bytes):
                values = shard(batch.column("doc_id")[lo:hi], raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                yield pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(values, arrow)], schema=arrow)

    return rows.mapInArrow(run, schema)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Shard:
    """Postings by document for random access, and by term and falling impact for sorted access."""

    def __init__(self, row: dict, n_terms: int, n_docs: int, n_words: int):
        as_ints = {c: np.asarray(row[c], np.int64) for c in ("n", "starts", "term", "tf")}
        doc, tf = np.repeat(np.arange(len(row["ids"])), np.diff(as_ints["starts"])), as_ints["tf"]
        length = 10 + (90 * as_ints["n"] * n_docs) // max(1, n_words)
        self.ids, self.n_terms = row["ids"], n_terms
        self.keys = doc * n_terms + as_ints["term"]  # ascending
        self.impacts = (1_000_000_000 * tf) // (1000 * tf + 8 * length[doc])
        order = np.lexsort((-self.impacts, as_ints["term"]))
        self.list_terms, self.list_docs, self.list_impacts = as_ints["term"][order], doc[order], self.impacts[order]

    def scores(self, docs: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Whole scores of documents, looked up in the forward index."""
        keys = docs[:, None] * self.n_terms + terms
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return (np.where(self.keys[at] == keys, self.impacts[at], 0) * weights).sum(axis=1)

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, kth: int, first_depth: int = FIRST_DEPTH) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents (places in the shard) and scores, among them all of the best ``k`` that reach ``kth``; entries read."""
        lo, hi = np.searchsorted(self.list_terms, terms, "left"), np.searchsorted(self.list_terms, terms, "right")
        docs, scores, seen = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(self.ids), bool)
        depth, more, read = 0, first_depth, 0
        while True:
            live = np.flatnonzero(lo + depth < hi)
            threshold = int((self.list_impacts[lo[live] + depth] * weights[live]).sum())
            if threshold <= 0 or threshold < kth:
                return docs, scores, read
            met = np.concatenate([self.list_docs[lo[i] + depth : min(lo[i] + depth + more, hi[i])] for i in live])
            read += len(met)
            new = np.unique(met[~seen[met]])
            seen[new] = True
            docs, scores = np.append(docs, new), np.append(scores, self.scores(new, terms, weights))
            if len(scores) >= k:
                kth = max(kth, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
                keep = scores >= kth
                docs, scores = docs[keep], scores[keep]
            depth += more
            more *= 2


def _best(found: list[tuple[int, int | None]], k: int) -> list[tuple[int, int | None]]:
    """The best (score, id), ties to the smaller id, nulls last."""
    return sorted(found, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]


def _block(docs: DataFrame, items: list, k: int, id_col: str, text_col: str, shard_bytes: int) -> DataFrame:
    """item_id, doc_id, score: the k best documents that each task found for each item."""
    own = [np.array(r["terms"], np.int64).view(np.uint64) for r in items]
    terms = np.unique(np.concatenate(own))
    index = pinned(forward_index(docs, terms, id_col, text_col, shard_bytes), "lexical-index")
    sums = index.agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")).first()
    n_docs, n_words = int(sums["docs"] or 0), int(sums["words"] or 0)
    held = index.select(F.explode(F.arrays_zip("held", "df")).alias("t")).groupBy("t.held").agg(F.sum("t.df").alias("df"))
    weights = np.zeros(len(terms), np.int64)
    for r in held.collect():  # one row for each of the block's terms at most
        weights[r["held"]] = weight(n_docs, r["df"])
    ids = [r["item_id"] for r in items]
    places = [np.searchsorted(terms, x).astype(np.int64) for x in own]
    schema = StructType.fromDDL("item_id long, doc_id long, score long")

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        best: list[list[tuple[int, int | None]]] = [[] for _ in ids]
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].values for c in batch.schema.names}
                shard = Shard(row | {"ids": row["ids"].to_pylist()}, len(terms), n_docs, n_words)
                for item, at in enumerate(places):
                    kth = best[item][-1][0] if len(best[item]) == k else 0
                    found, scores, _ = shard.search(at, weights[at], k, kth)
                    if len(found):
                        best[item] = _best(best[item] + [(s, shard.ids[d]) for d, s in zip(found.tolist(), scores.tolist()) if s > 0], k)
        rows = [(ids[item], doc, score) for item, some in enumerate(best) for score, doc in some]
        arrow = to_arrow_schema(schema)
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(arrow)], schema=arrow)

    return index.select("ids", "n", "starts", "term", "tf").mapInArrow(run, schema)


def search(docs: DataFrame, items: DataFrame, k: int = K, block_terms: int = BLOCK_TERMS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents of each item with the highest scores above 0."""
    asked = pinned(item_terms(items, item_col), "lexical-items")
    total = int(asked.agg(F.sum(F.size("terms"))).first()[0] or 0)
    blocks = -(-total // block_terms)
    out = docs.sparkSession.createDataFrame([], "item_id long, doc_id long, score long")
    for block in range(blocks):
        some = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id").collect()
        if some:
            out = out.union(_block(docs, some, k, id_col, text_col, shard_bytes))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def op13_lexical(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
     t AS (SELECT r, doc_id, {_TERMS} AS term FROM d),
     p AS (SELECT r, doc_id, term, count(*) AS tf FROM t GROUP BY r, doc_id, term),
     n AS (SELECT r, sum(tf)::BIGINT AS n FROM p GROUP BY r),
     s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM n),
     f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
     q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, {_TERMS} AS term FROM benchmark)),
     w AS (SELECT q.item_id, q.term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM q JOIN f USING (term), s),
     m AS (SELECT r, 10 + (90 * n * docs) // words AS m FROM n, s),
     a AS (SELECT item_id, p.r, p.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
           FROM w JOIN p USING (term) JOIN m ON p.r = m.r GROUP BY item_id, p.r, p.doc_id),
     k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM a WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
"""
