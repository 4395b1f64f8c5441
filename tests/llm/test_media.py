"""GIF streams with dictionary codes, frames that need disposal and transparency, and what the query gives of them."""

import hashlib
import random

import numpy as np

from codeweft.llm import media

from test_operators import textbook_lzw


def plain_decode(data, min_size):
    """Code by code, word by word."""
    clear, words, size, out, last = 1 << min_size, {}, min_size + 1, b"", None
    bits, at = int.from_bytes(data, "little"), 0
    while True:
        code = bits >> at & ((1 << size) - 1)
        at += size
        if code == clear:
            words, size, last = {i: bytes([i]) for i in range(clear)}, min_size + 1, None
            continue
        if code == clear + 1:
            return out
        word = words[code] if code in words else last + last[:1]
        if last is not None and len(words) + 2 < 4096:
            words[len(words) + 2] = last + word[:1]
            if len(words) + 2 == 1 << size and size < 12:
                size += 1
        out, last = out + word, word


def texts():
    rng = random.Random(4)
    words = ["the", "bridge", "Äpfel", "repaired", "zum", "mit", "\n", "1234"]
    return [b"", b"a", b" " * 500, b"ab" * 9000] + [" ".join(rng.choice(words) for _ in range(rng.choice([3, 400, 9000]))).encode() for _ in range(12)]


def test_streams_are_read_by_a_plain_decoder_and_textbook_streams_by_this_one():
    rng = np.random.default_rng(1)
    samples = [np.frombuffer(x, np.uint8) for x in texts()] + [rng.integers(0, 256, n, dtype=np.uint8) for n in (1, 4000, 30_000)]
    streams = media.lzw_encode_many(samples)
    for x, stream in zip(samples, streams):
        assert plain_decode(stream, 8) == x.tobytes()
    assert [x.tobytes() for x in media.lzw_decode_many(streams, [len(x) for x in samples])] == [x.tobytes() for x in samples]
    assert len(streams[3]) < len(samples[3]) / 20  # words grow, and codes with them
    some = [x.tobytes()[:9000] for x in samples if len(x)]
    assert [x.tobytes() for x in media.lzw_decode_many([textbook_lzw(x, 8) for x in some], [len(x) for x in some])] == some
    short = media.lzw_decode_many([streams[3][:50]], [18_000])[0]
    assert len(short) == 18_000 and short[:10].tobytes() == b"ababababab" and short[-1] == 0


def test_frames_need_transparency_and_disposal():
    text = ("the committee met for three hours on tuesday and agreed after much debate " * 400).encode()
    payload = media.pad(text)
    data = media.gif_encode(payload)
    stored = list(media.gif_frames(data))
    assert {f["disposal"] for f in stored} == {1, 2, 3} and any((f["indices"] == f["clear_index"]).any() for f in stored)
    assert b"".join(f["indices"].tobytes() for f in stored) != payload  # only what is shown is the text
    assert b"".join(f["rgb"][f["box"]][..., 0].tobytes() for f in media.gif_decode(data)) == payload


def test_query_gives_frames_with_colours(spark):
    sf = "/root/testdata/sf0.001"
    own = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in media.op4_media(spark, sf).collect():
        payload = media.pad(own[r["doc_id"]])
        rows = np.frombuffer(payload, np.uint8).reshape(-1, 192)
        assert r["media_sha256"] == hashlib.sha256(media.gif_encode(payload)).hexdigest()
        assert [(f["start_ms"], f["height"]) for f in r["frames"]] == [(100 * i, len(rows[16 * i : 16 * i + 16])) for i in range(-(-len(rows) // 16))]
        for i, f in enumerate(r["frames"]):
            part = rows[16 * i : 16 * i + 16].reshape(-1).astype(int)
            assert f["red"] == np.bincount(part >> 4, minlength=16).tolist() and f["green"] == np.bincount((255 - part) >> 4, minlength=16).tolist()
            assert f["blue"] == np.bincount((7 * part & 255) >> 4, minlength=16).tolist()


def test_a_long_text(spark):
    text = "".join(f"line {i} of a long text\n" for i in range(150_000))
    row = media.media_columns(spark.createDataFrame([(1, text)], "doc_id long, text string"), frames=True).first()
    assert row["payload_sha256"] == hashlib.sha256(media.pad(text.encode())).hexdigest() and len(row["frames"]) == -(-row["payload_bytes"] // (192 * 16))
