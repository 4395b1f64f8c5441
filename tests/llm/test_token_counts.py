"""Token counts of the compiled transducer against the tokenizer itself."""

import random

import public_tokenizers
import sentencepiece

from codeweft.llm import token_counts

SF = "/root/testdata/sf0.01"


def tokenizer():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_counts.MODEL))


def hard_texts():
    rng = random.Random(7)
    pieces = list(token_counts.compiled(public_tokenizers.path(token_counts.MODEL)).score)
    out = ["", "a", " ", "  ", "\n\n", " " * 100, "a" * 700, "<s>x</s>\x00 <unk>", "▁ ▁a", "😀😀é", "ab" * 3000, "=" * 70, "x́" * 40]
    out += ["".join(rng.choice(pieces) * rng.choice([1, 1, 3]) for _ in range(rng.randint(1, 30))) for _ in range(600)]
    return out + ["".join(rng.choice("abcde fghi  lnt\n▁") for _ in range(rng.randint(1, 300))) for _ in range(400)]


def test_query_equals_the_tokenizer(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in token_counts.op11_token_counts(spark, SF).collect()}
    want = dict(zip(texts, map(len, tokenizer().encode(list(texts.values()), num_threads=1))))
    assert {i: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for i, r in got.items()} == {i: (len(t.encode()), want[i], want[i] > 4096) for i, t in texts.items()}


def test_any_chunks_give_the_same_counts():
    texts = hard_texts()
    want = [len(x) for x in tokenizer().encode(texts)]
    transducer = token_counts.Transducer(public_tokenizers.path(token_counts.MODEL))
    for chunk, slab in ((8192, 1 << 20), (64, 2000), (7, 500), (1, 100)):
        assert transducer.count([t.encode() for t in texts], chunk, slab) == want


def test_a_full_table_starts_afresh(monkeypatch):
    monkeypatch.setattr(token_counts, "MOST_STATES", 500)
    texts = hard_texts()
    transducer = token_counts.Transducer(public_tokenizers.path(token_counts.MODEL))
    assert transducer.count([t.encode() for t in texts], 64, 2000) == [len(x) for x in tokenizer().encode(texts)]


def test_maps_compose_associatively():
    t = token_counts.Transducer(public_tokenizers.path(token_counts.MODEL))
    import numpy as np

    symbols = [t.symbols_of(x.encode(), i == 0) for i, x in enumerate(["the intern", "ationali", "sation", "s of", " unbelie", "vable"])]
    lengths = np.array([len(s) for s in symbols])
    maps = t.maps(np.concatenate(symbols), np.cumsum(lengths) - lengths, np.array([True, False, False, False, False, False]))
    for i in range(len(maps) - 2):
        a, b, c = ([m] for m in maps[i : i + 3])
        (left,), (right,) = t.compose(t.compose(a, b), c), t.compose(a, t.compose(b, c))
        assert (left.whole, left.count, left.exit, left.head.tolist()) == (right.whole, right.count, right.exit, right.head.tolist())


def test_odd_rows_and_a_long_text(spark, odd, none):
    rows = token_counts.token_counts(odd).collect()
    assert len(rows) == odd.count()
    want = {(r["doc_id"], len(tokenizer().encode(r["text"] or ""))) for r in odd.collect()}
    assert {(r["doc_id"], r["n_tokens"]) for r in rows} == want
    assert token_counts.token_counts(none).collect() == []
    long = "supercalifragilistic expialidocious, " * 60_000
    row = token_counts.token_counts(spark.createDataFrame([(1, long)], "doc_id long, text string")).first()
    assert (row["n_tokens"], row["over_limit"]) == (len(tokenizer().encode(long)), True)
