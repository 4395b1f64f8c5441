"""Language-model scoring by deleted interpolation.

Maximum-likelihood estimates of word triples, pairs and single words and a uniform share are mixed with
weights that depend on how often the context was seen (powers of two), learned by expectation-
maximisation on held-out counts: a fold of the training documents is scored with the counts of the
others. All counts cover all training documents and grow with them. An estimate whose context was
never seen has no weight, so the mixture sums to one over the vocabulary and one unknown word.

How it runs: documents become blocks of token hashes (64 bits). A block sends its distinct words, pairs
and triples, sorted, in slices by hash range, once each, so a frequent one weighs no more than the
number of blocks. Each range adds up its counts and sends every block the totals of the block's keys.
Blocks meet their totals again, first the fold's blocks (for the weights, as a histogram over rounded
probabilities), then all of them for the scores. Only a weight row for each context bucket is collected.

Words are kept as 64-bit hashes; pairs and triples as ``KEY_SLACK`` bits more than the number of tokens
has, 64 at most, so the chance that one meets another by hash is under 2 ** -KEY_SLACK at every size.

Results for odd input: null and blank texts are one end token; a null id counts as held out and is
not learned from; repeated rows are learned from and scored each; without training documents the
base is log10(1) for each token and the model uniform; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import fold, pinned, table
from .hashing import NON_SPACE, chunks, column_bytes, pair, tokens

TOKEN_BYTES = 512 << 10
BLOCK_BYTES = 12 << 20
#: Tokens of a hash range, about, and the least number of ranges.
RANGE_TOKENS, LEAST_RANGES = 1 << 20, 32
KEY_SLACK = 20
END, START, START_PAIR = np.uint64(0x5EED0E4D), np.uint64(0x5EED57A7), np.uint64(0x5EED57A9)
#: Powers of two of a context's count; half powers of two of a probability.
COUNTS, STEPS = 40, 100
#: Contexts: nothing learned; word unseen; word seen, by its count; pair seen, by its count.
CONTEXTS = 2 + 2 * COUNTS
#: Shares of triple, pair, word and uniform before any were learned.
FIRST_SHARES = (0.4, 0.3, 0.2, 0.1)


def _pack(values: np.ndarray) -> bytes:
    """Bytes of an array, by significance, compressed."""
    import pyarrow as pa

    raw = np.ascontiguousarray(values)
    planes = raw.view(np.uint8).reshape(len(raw), raw.itemsize).T.tobytes()
    return struct.pack("<Q", len(raw)) + (pa.compress(planes, codec="zstd", asbytes=True) if planes else b"")


def _unpack(data: bytes, dtype) -> np.ndarray:
    import pyarrow as pa

    n, width = struct.unpack_from("<Q", data)[0], np.dtype(dtype).itemsize
    if not n:
        return np.zeros(0, dtype)
    planes = np.frombuffer(pa.decompress(data[8:], decompressed_size=n * width, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(dtype).reshape(-1)


def _pack_keys(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, np.uint64), dtype=np.uint64)


def blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """block, is_fold, ids, roles (0 held out, 1 trained on, 2 trained on and in the fold), counts, n_train, words, ranks, stream.

    A block's documents are all in the fold or all out of it; ``words`` are its distinct token hashes,
    ``ranks`` their places by falling frequency and ``stream`` the ranks of its tokens in reading order.
    """
    part = F.coalesce(fold(F.col(id_col), 7), F.lit(2))
    role = F.when(part == 2, 0).when(part == 0, 2).otherwise(1).cast("int")
    rows = docs.select(F.col(id_col).alias("doc_id"), role.alias("role"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = StructType.fromDDL(f"block long, is_fold boolean, ids array<{kind}>, roles array<int>, counts array<int>, n_train long, words binary, ranks binary, stream binary")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, made = to_arrow_schema(schema), TaskContext.get().partitionId() << 32
        for batch in batches:
            roles = np.asarray(batch.column("role"))
            for in_fold in (False, True):
                some = batch.filter(pa.array((roles == 2) == in_fold))
                if not some.num_rows:
                    continue
                raw, offsets = column_bytes(some.column("raw"))
                for lo, hi in chunks(offsets, block_bytes):
                    hashes, counts, inner = [], [], offsets[lo : hi + 1]
                    for a, b in chunks(inner, TOKEN_BYTES):
                        h, n = tokens(raw[inner[a] : inner[b]], inner[a : b + 1] - inner[a], NON_SPACE)[:2]
                        hashes.append(h)
                        counts.append(n)
                    counts = np.concatenate(counts).astype(np.int32)
                    words, stream, times = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
                    ranks = np.empty(len(words), np.int32)
                    ranks[np.argsort(-times, kind="stable")] = np.arange(len(words), dtype=np.int32)
                    own = np.asarray(some.column("role"))[lo:hi]
                    n_train = int((counts + 1)[own > 0].sum())
                    values = [made, in_fold, some.column("doc_id")[lo:hi].to_pylist(), own.tolist(), counts.tolist(), n_train, _pack_keys(words), _pack(ranks), _pack(ranks[stream])]
                    yield pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(values, arrow)], schema=arrow)
                    made += 1

    return rows.mapInArrow(run, schema)


STORED = ("block", "is_fold", "roles", "counts", "words", "ranks", "stream")


class _Block:
    """A block's tokens, with an end token for each document, and its distinct words, pairs and triples."""

    def __init__(self, row: dict, key_bits: int):
        self.block, self.is_fold, self.shift = row["block"], row["is_fold"], np.uint64(64 - key_bits)
        self.counts = np.asarray(row["counts"], np.int64) + 1
        self.roles = np.asarray(row["roles"])
        ranks = _unpack(row["ranks"], np.int32)
        by_rank = np.empty(len(ranks), np.uint64)
        by_rank[ranks] = _unpack_keys(row["words"])
        ends = np.cumsum(self.counts) - 1
        self.starts = np.concatenate([[0], ends[:-1] + 1])
        self.seq = np.full(int(self.counts.sum()), END, np.uint64)
        inside = np.ones(len(self.seq), bool)
        inside[ends] = False
        self.seq[inside] = by_rank[_unpack(row["stream"], np.int32)]

    def _after(self, values: np.ndarray, first) -> np.ndarray:
        """What stands one token earlier; ``first`` where a text starts."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.starts] = first
        return out

    def keys(self):
        """(kind, distinct keys, each token's place among them), one kind at a time."""
        found, at = np.unique(self.seq, return_inverse=True)
        yield "w", found, at.astype(np.int32)
        del found, at
        with np.errstate(over="ignore"):
            pairs = pair(self._after(self.seq, START), self.seq, 7)
            found, at = np.unique(pairs >> self.shift, return_inverse=True)
            yield "p", found, at.astype(np.int32)
            del found, at
            triples = pair(self._after(pairs, START_PAIR), self.seq, 9) >> self.shift
        del pairs
        found, at = np.unique(triples, return_inverse=True)
        yield "t", found, at.astype(np.int32)

    def slices(self, bits: int):
        """(range, kind, keys, trained counts) of each hash range that has keys."""
        trained = np.repeat(self.roles > 0, self.counts)
        for kind, keys, at in self.keys():
            own = np.bincount(at[trained], minlength=len(keys)).astype(np.int32)
            width = np.uint64((64 if kind == "w" else 64 - int(self.shift)) - bits)
            cuts = np.searchsorted((keys >> width).astype(np.int64), np.arange((1 << bits) + 1))
            for r in np.flatnonzero(np.diff(cuts)):
                s = slice(cuts[r], cuts[r + 1])
                yield int(r), kind, keys[s], own[s]

    def estimates(self, totals, n_train: int, fold_out: bool):
        """Counts of each token's word, and probabilities by triple, pair and word, and the context's bucket.

        ``totals``: rows (range, kind, trained, folded) as lists; with ``fold_out`` the fold's own counts are left out.
        """
        counts, ends = {}, self.starts + self.counts - 1
        for kind, _, at in self.keys():
            rows = sorted((r, t, f) for r, k, t, f in zip(*totals) if k == kind)
            total = np.concatenate([np.zeros(0, np.int64), *(_unpack(t, np.int64) for _, t, _ in rows)])
            if fold_out:
                total -= np.concatenate([np.zeros(0, np.int64), *(_unpack(f, np.int64) for _, _, f in rows)])
            counts[kind] = total[at]
        texts = counts["w"][ends]  # a text starts as often as one ends
        word = self._after(counts["w"], texts)
        pairs = self._after(counts["p"], texts)
        bucket = _context(pairs, word, n_train)
        triple = counts.pop("t") / np.maximum(pairs, 1)
        two = counts.pop("p") / np.maximum(word, 1)
        return counts["w"], triple, two, counts["w"] / max(1, n_train), bucket


def _context(pairs: np.ndarray, word: np.ndarray, n_train: int) -> np.ndarray:
    def power(count):
        return np.minimum(COUNTS - 1, np.log2(np.maximum(count, 1)).astype(np.int64))

    if not n_train:
        return np.zeros(len(word), np.int64)
    return np.where(pairs > 0, 2 + COUNTS + power(pairs), np.where(word > 0, 2 + power(word), 1))


def _open(context: int) -> np.ndarray:
    """Which of triple, pair, word and uniform a context has estimates for."""
    return np.array([context >= 2 + COUNTS, context >= 2, context >= 1, True])


def _steps(p: np.ndarray) -> np.ndarray:
    """0 for no probability, else 1 + half powers of two below 1."""
    return np.where(p > 0, np.minimum(STEPS - 1, 1 + np.round(-2 * np.log2(np.maximum(p, 2.0**-60))).astype(np.int64)), 0)


def _of_step(step: np.ndarray) -> np.ndarray:
    return np.where(step > 0, 2.0 ** (-(step - 1) / 2), 0.0)


def learn_shares(rows: pd.DataFrame, context: int, uniform: float, rounds: int = 60) -> np.ndarray:
    """Mixture weights (triple, pair, word, uniform) of one context bucket by EM over held-out counts."""
    open_ = _open(context)
    p = np.stack([_of_step(rows[c].to_numpy()) for c in ("triple", "two", "word")] + [np.full(len(rows), uniform)], axis=1)
    n = rows["n"].to_numpy(np.float64)
    w = np.where(open_, FIRST_SHARES, 0.0)
    w /= w.sum()
    for _ in range(rounds):
        share = p * w
        share /= share.sum(axis=1, keepdims=True)
        w = np.where(open_, (share * n[:, None]).sum(axis=0) + 1e-3, 0.0)
        w /= w.sum()
    return w


def all_shares(learned: dict[int, np.ndarray]) -> np.ndarray:
    """Weights of every context: learned, else of the nearest learned one with the same estimates, else the first shares."""
    out = np.zeros((CONTEXTS, 4))
    for context in range(CONTEXTS):
        alike = [c for c in learned if (_open(c) == _open(context)).all()]
        first = np.where(_open(context), FIRST_SHARES, 0.0)
        out[context] = learned[min(alike, key=lambda c: (abs(c - context), c))] if alike else first / first.sum()
    return out


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row."""
    stored = pinned(blocks(docs, id_col, text_col, block_bytes), "lm-blocks")
    sums = stored.agg(F.sum("n_train").alias("n"), F.sum(F.when(F.col("is_fold"), F.col("n_train"))).alias("fold"), F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x + 1)).alias("all")).first()
    n_train, n_fold, n_all = (int(x or 0) for x in sums)
    bits = int(np.ceil(np.log2(max(LEAST_RANGES, n_all / RANGE_TOKENS))))
    key_bits = min(64, int(np.ceil(np.log2(n_all + 2))) + KEY_SLACK)
    some = stored.select(*STORED)

    slice_schema = StructType.fromDDL("range int, kind string, block long, is_fold boolean, keys binary, trained binary")

    def send(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(slice_schema)
        for batch in batches:
            for i in range(batch.num_rows):
                block = _Block(batch.slice(i, 1).to_pylist()[0], key_bits)
                rows = ((r, kind, block.block, block.is_fold, _pack_keys(keys), _pack(trained)) for r, kind, keys, trained in block.slices(bits))
                while held := list(islice(rows, 64)):
                    yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*held), arrow)], schema=arrow)

    def add(rows):
        """Totals of each slice's keys, in one hash range; ``folded`` only for blocks of the fold."""
        import pyarrow as pa

        kinds, in_fold, out = np.asarray(rows["kind"].to_pylist()), np.asarray(rows["is_fold"]), []
        for kind in sorted(set(kinds)):
            own = np.flatnonzero(kinds == kind)
            mine = rows.take(pa.array(own))
            keys = [_unpack_keys(x.as_py()) for x in mine["keys"]]
            cuts = np.cumsum([0, *map(len, keys)])
            found, at = np.unique(np.concatenate(keys), return_inverse=True)
            del keys
            total, folded = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
            for i, x in enumerate(mine["trained"]):
                some_at, n = at[cuts[i] : cuts[i + 1]], _unpack(x.as_py(), np.int32)
                total[some_at] += n  # a slice's keys are distinct
                if in_fold[own[i]]:
                    folded[some_at] += n
            known = int((total > 0).sum()) if kind == "w" else 0
            for i, (block, r) in enumerate(zip(mine["block"].to_pylist(), mine["range"].to_pylist())):
                some_at = at[cuts[i] : cuts[i + 1]]
                out.append((block, r, kind, _pack(total[some_at]), _pack(folded[some_at]) if in_fold[own[i]] else None, known if i == 0 else 0))
        fields = [("block", pa.int64()), ("range", pa.int32()), ("kind", pa.string()), ("trained", pa.binary()), ("folded", pa.binary()), ("n_distinct", pa.int64())]
        return pa.Table.from_arrays([pa.array(x, type=t) for x, (_, t) in zip(zip(*out), fields)], names=[n for n, _ in fields])

    def of_block(block, totals):
        if not block.num_rows:
            return None, None
        return _Block(block.to_pylist()[0], key_bits), [totals[c].to_pylist() for c in ("range", "kind", "trained", "folded")]

    sent = some.mapInArrow(send, slice_schema)
    totals = pinned(sent.groupBy("range").applyInArrow(add, "block long, range int, kind string, trained binary, folded binary, n_distinct long"), "lm-totals")
    distinct = int(totals.agg(F.sum("n_distinct")).first()[0] or 0)
    uniform = 1.0 / (distinct + 1)

    def held_out(left, right):
        import pyarrow as pa

        block, rows = of_block(left, right)
        names = ["context", "triple", "two", "word", "n"]
        if block is None:
            return pa.table({c: pa.array([], pa.int64()) for c in names})
        _, triple, two, word, context = block.estimates(rows, n_train - n_fold, True)
        code = ((context * STEPS + _steps(triple)) * STEPS + _steps(two)) * STEPS + _steps(word)
        codes, n = np.unique(code, return_counts=True)
        return pa.table(dict(zip(names, (codes // STEPS**3, codes // STEPS**2 % STEPS, codes // STEPS % STEPS, codes % STEPS, n))))

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        context = int(rows["context"].iloc[0])
        return pd.DataFrame({"context": [context], "shares": [learn_shares(rows, context, uniform).tolist()]})

    of_fold = some.where("is_fold")
    theirs = totals.where("folded IS NOT NULL")
    histogram = of_fold.groupBy("block").cogroup(theirs.groupBy("block")).applyInArrow(held_out, "context long, triple long, two long, word long, n long").groupBy("context", "triple", "two", "word").agg(F.sum("n").alias("n"))
    # One row for each context bucket, at most CONTEXTS.
    learned = histogram.groupBy("context").applyInPandas(learn, "context long, shares array<double>").collect()
    shares = all_shares({r["context"]: np.array(r["shares"]) for r in learned})
    kind = docs.schema[id_col].dataType.simpleString()
    schema = StructType.fromDDL(f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")

    def judge(left, right):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        block, rows = of_block(left.drop_columns(["ids"]), right)
        if block is None:
            return arrow.empty_table()
        count, triple, two, word, context = block.estimates(rows, n_train, False)
        base = np.add.reduceat(np.log10((count + 1) / (n_train + distinct + 1)), block.starts)
        known = np.add.reduceat((count > 0).astype(np.int64), block.starts)
        del count
        model = shares[context, 3] * uniform
        for i, p in enumerate((triple, two, word)):
            model += shares[context, i] * p
        ids = left["ids"].combine_chunks().flatten()
        values = [ids, block.roles == 0, block.counts, known, base, np.add.reduceat(np.log10(model), block.starts)]
        return pa.Table.from_arrays([pa.array(v).cast(f.type) if i else v.cast(f.type) for i, (v, f) in enumerate(zip(values, arrow))], schema=arrow)

    judged = stored.select("ids", *STORED).groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(judge, schema)
    return judged.withColumn("train_tokens", F.lit(n_train).cast("long")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_lm(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
