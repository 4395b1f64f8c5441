"""Operators against plain Python on small tables, and their defined results for odd input."""

import collections
import hashlib
import math
import re
import struct
import time
import zlib
from re import _parser

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeweft.llm import html_text, hashing, licenses, lm, media, mixing, packing, quality, simhash, topk, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source", "lang", "n_chars")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


# ---- 1


def exact_top(rows, k):
    """``rows``: (id, vector); rows that repeat an id are rows of their own."""
    out = []
    for a, (q, v) in enumerate(rows):
        if q % 50 == 0:
            best = sorted((-int(np.dot(v, w)), i) for b, (i, w) in enumerate(rows) if a != b)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_topk_equals_brute_force(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    vectors = [(r["vec_id"], np.floor(256 * np.array(r["embedding"], np.float64)).astype(np.int64)) for r in table.collect()]
    got = topk.op1_topk(spark, SF)
    assert sorted(tuple(r) for r in got.collect()) == exact_top(vectors, 5)


def test_topk_clustered_ties_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8)) * 40
    rows = [(i, [float(x) for x in np.round(centres[i % 6] + rng.normal(size=8))]) for i in range(4000)]
    rows += [(4000 + i, [1.0] * 8) for i in range(900)]  # copies
    rows += [(3, rows[3][1]), (50, [5.0] * 8), (50, [5.0] * 8), (51, rows[50][1])]  # repeated ids
    vectors = [(i, np.array([math.floor(256 * x) for x in v])) for i, v in rows]
    rows += [(9000, None), (9001, [1.0, None] * 4), (9002, [float("nan")] * 8), (9003, [float("inf")] * 8), (None, [1.0] * 8), (9050, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"v": F.lit(1), "row": F.lit(2), "place": F.lit("x")})
    got = topk.top_k(topk.quantised(table), F.col("vec_id") % 50 == 0, data_block=600, query_chunk=40)
    assert sorted(tuple(r) for r in got.collect()) == exact_top(vectors, 5)


def test_cover_tree_covers_and_separates():
    rng = np.random.default_rng(2)
    points = np.concatenate([c + rng.normal(size=(150, 5)) for c in rng.normal(size=(8, 5)) * 60] + [np.zeros((40, 5))])
    tree = topk.CoverTree(points)
    assert tree.depth() >= 4 and sorted(tree.order) == list(range(len(points)))
    for i in range(len(tree.lo)):
        own = tree.order[tree.lo[i] : tree.hi[i]]
        assert np.linalg.norm(points[own] - points[tree.centre[i]], axis=1).max() <= tree.radius[i] + 1e-6
        children = range(tree.first[i], tree.last[i])
        if len(children):
            assert [tree.lo[children[0]], tree.hi[children[-1]]] == [tree.lo[i], tree.hi[i]]
            centres = points[tree.centre[list(children)]]
            apart = np.linalg.norm(centres[:, None] - centres[None], axis=2)[np.triu_indices(len(centres), 1)]
            assert (apart > tree.radius[i] / 2 - 1e-6).all() and max(tree.radius[c] for c in children) <= tree.radius[i] / 2 + 1e-6


def test_dual_tree_leaves_out_most_pairs_of_clustered_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    data = np.floor(np.concatenate([c * 360 / np.linalg.norm(c) + rng.normal(size=(200, 16)) * 4 for c in centres])).astype(np.int64)
    ids, asked, seen = np.arange(len(data)), np.arange(0, len(data), 25), {}
    norm = float((data * data).sum(axis=1).max())
    scores, at = topk.search_block(asked, data[asked], np.full(len(asked), -np.inf), ids, ids, data, 5, norm, seen)
    for row, q in enumerate(asked):
        want = sorted((-int(data[q] @ data[i]), i) for i in ids if i != q)[:5]
        assert [(-int(s), int(i)) for s, i in zip(scores[row], at[row])] == want
    assert seen["scored"] < 0.2 * seen["pairs"] and seen["data_levels"] > 3 and seen["query_levels"] >= 2
    rows = [np.floor(256 * np.array(r["embedding"], np.float64)).astype(np.int64) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    data, seen = np.stack(rows), {}
    ids = np.arange(len(data))
    topk.search_block(ids[::50], data[::50], np.full(len(ids[::50]), -np.inf), ids, ids, data, 5, float((data * data).sum(axis=1).max()), seen)
    print("pairs scored on the driver's vectors:", seen)  # directions without clusters: see the README
    assert seen["data_levels"] >= 2


def test_topk_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(topk.quantised(few), F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 1, 131072)]
    assert topk.top_k(topk.quantised(few.limit(0)), F.col("vec_id") % 50 == 0).count() == 0


# ---- 2


def sainte_lague(votes, seats):
    won = collections.Counter()
    for _ in range(seats):
        best = max(sorted(votes, key=str), key=lambda k: votes[k] / (2 * won[k] + 1))
        won[best] += 1
    return won


def test_apportionment_equals_highest_quotients(spark):
    rng = np.random.default_rng(2)
    for seats in (0, 1, 7, 100, 1009):
        votes = {f"k{i:02d}": float(x) for i, x in enumerate(rng.integers(0, 1000, 17))}
        table = spark.createDataFrame([(k, v, 1, seats) for k, v in votes.items()], "k string, votes double, g int, s long")
        got = {r["k"]: r["quota"] for r in mixing.sainte_lague(table, ["k"], ["g"], "s").collect()}
        assert got == {k: sainte_lague(votes, seats)[k] for k in votes}


def test_mix_meets_targets(spark, docs, texts):
    rows = mixing.op2_mixing(spark, SF).collect()
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    assert {r["doc_id"]: r["size"] for r in rows} == {i: len(WORD.findall(t)) for i, t in texts.items()}
    taken, target, size = collections.Counter(), {}, collections.Counter()
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
        size[source[r["doc_id"]]] += r["size"]
        target[source[r["doc_id"]]] = r["target"]
    weights = dict(zip(sorted(size), [3, 1, 2] * 10))
    level, open_ = None, set(size)
    while True:  # the rule as written: cap, share the excess again
        rest = 1.5 * sum(size.values()) - sum(2 * size[s] for s in size if s not in open_)
        level = rest / sum(weights[s] for s in open_)
        over = {s for s in open_ if level * weights[s] > 2 * size[s]}
        if not over:
            break
        open_ -= over
    for s in size:
        assert target[s] == pytest.approx(level * weights[s] if s in open_ else 2 * size[s])
        assert abs(taken[s] - target[s]) <= 0.02 * target[s] + 32
    again = mixing.op2_mixing(spark, SF).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_mixed_documents_tell_rows_apart(spark):
    rows = [(None, f"null {i} " * 30, "a") for i in range(40)] + [(5, f"five {i} " * 30, "b") for i in range(40)] + [(i, f"one {i} " * 30, "c") for i in range(100, 140)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    counts = {(r["doc_id"], r["text"]): r["count"] for r in mixing.mixed_documents(docs).groupBy("doc_id", "text").count().collect()}
    assert max(counts.values()) <= 2 and len({t for i, t in counts if i is None}) >= 39 and len({t for i, t in counts if i == 5}) >= 18
    assert sum(counts.values()) == pytest.approx(1.5 * len(rows), abs=4)


def test_mix_odd_rows(odd, none):
    rows = mixing.mix(odd).collect()
    assert len(rows) == 9 and {r["doc_id"]: r["size"] for r in rows if r["doc_id"] in (2, 3, 5, 7)} == {2: 0, 3: 0, 5: 0, 7: 1}
    assert mixing.mix(none).count() == 0
    copies = mixing.mixed_documents(odd)
    assert copies.columns == odd.columns and copies.where("doc_id IN (2, 3, 5)").count() == 0


# ---- 3


def test_html_cases():
    page = """<html><head><title>No</title></head><body><header><a href="/">Home</a></header><div class="sidebar">Side text that is long enough to look like prose, but is not.</div>
    <main><h1>Caf&eacute; &amp; bar</h1><p>First   line<br>goes on.</p><p>It <b>wo</b>rks</p><aside>Aside</aside><form>Mail <input></form></main><!-- <p>hidden</p> --><script>var a = "<p>x</p>"</script>
    <section id="comments"><p>I disagree with this, and here is why at some length.</p></section><footer>&copy; us</footer></body></html>"""
    assert html_text.main_text(page) == "Café & bar\nFirst line goes on.\nIt works"
    assert html_text.main_text("") == "" and html_text.main_text("<nav>a</nav>") == "" and html_text.main_text("<p") == ""
    assert html_text.main_text("<article><p>one<p>two <script>x") == "one\ntwo"


LONG = "The committee met for three hours on Tuesday and agreed, after much debate, that the bridge should be repaired before winter and paid for by the county."
NINE_LINKS = " ".join(f"<a href='/{i}'>Some more news</a>" for i in range(9))


def test_html_without_telling_elements_and_with_misleading_names():
    cases = {
        f"<p>{LONG}</p><p>Nobody was hurt.</p><p>The mayor spoke at noon today.</p><p>{LONG}</p><div>{NINE_LINKS}</div>": [LONG, "Nobody was hurt.", "The mayor spoke at noon today.", LONG],
        f"<article><h1>Law</h1><div class='legal'><p>{LONG}</p></div><p id='search-party'>{LONG}</p></article>": ["Law", LONG, LONG],
        f"<article><h1>T</h1><p>{LONG}</p><div class='user-discussion'><p>I agree with all that.</p></div><p>{NINE_LINKS}</p><p>Fine.</p></article>": ["T", LONG, "Fine."],
        f"<div>{NINE_LINKS}</div><div><h1>Bridge agreed</h1><p>{LONG}</p><p>{LONG}</p></div><div class='sidebar'><p>{LONG}</p></div>": ["Bridge agreed", LONG, LONG],
    }
    for page, want in cases.items():
        assert html_text.main_text(page).split("\n") == want


def test_html_tree_uses_density_and_neighbours_and_holds_on_new_pages():
    tree = html_text.trained_tree()
    assert {"words", "link_density", "words_before", "words_after", "links_before", "links_after"} <= html_text.used_features(tree)
    right = total = 0
    for page, marks in html_text.labelled_pages(150, seed=99):
        right += int((html_text.predict(tree, html_text.text_blocks(page)[1]) == (np.array(marks) == 1)).sum())
        total += len(marks)
    assert right > 0.98 * total


def test_html_pages(spark):
    import html

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in html_text.op3_html(spark, SF).collect():
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", pages[r["page_id"]], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])
    table = spark.createDataFrame([(1, "u", None), (2, None, "<article>x"), (2, None, "<article>x")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    assert sorted(r["text"] for r in html_text.extract(table, ["page_id", "url"]).collect()) == ["", "x", "x"]


# ---- 4


def test_gif_round_trip_and_rules():
    rng = np.random.default_rng(3)
    for n in (0, 1, 192, 193, 5000, 192 * 40):
        payload = media.pad(bytes(rng.integers(0, 256, n, dtype=np.uint8)))
        data = media.gif_encode(payload, max_rows=16)
        assert b"".join(f["rgb"][f["box"]][..., 0].tobytes() for f in media.gif_decode(data)) == payload
        stream = media.lzw_encode(np.frombuffer(payload, np.uint8))
        assert media.lzw_decode(stream, 8, len(payload)).tobytes() == payload
    # a compressed stream with growing codes, made by the textbook encoder
    samples = bytes(rng.integers(0, 4, 3000, dtype=np.uint8))
    assert media.lzw_decode(textbook_lzw(samples, 2), 2, len(samples)).tobytes() == samples
    # frames: the second covers one pixel, is transparent in the other and gives way to the background
    def frame(left, indices, control):
        return b"\x21\xf9\x04" + control + b"\x00\x2c" + np.array([left, 0, len(indices), 1], "<u2").tobytes() + b"\x00\x02" + media._blocks(textbook_lzw(bytes(indices), 2))

    gif = b"GIF89a" + np.array([2, 1], "<u2").tobytes() + b"\x80\x00\x00" + bytes([10, 10, 10, 200, 200, 200]) + frame(0, [0, 1], b"\x00\x05\x00\x00") + frame(0, [1, 0], b"\x09\x07\x00\x00") + frame(1, [0], b"\x00\x01\x00\x00") + b";"
    shown = [(f["start_cs"], f["rgb"][0, :, 0].tolist()) for f in (dict(x, rgb=x["rgb"].copy()) for x in media.gif_decode(gif))]
    assert shown == [(0, [10, 200]), (5, [200, 200]), (12, [0, 10])]


def textbook_lzw(samples, min_size):
    clear, end = 1 << min_size, (1 << min_size) + 1
    codes, words, size, word = [(clear, min_size + 1)], {bytes([i]): i for i in range(clear)}, min_size + 1, b""
    for x in samples:
        if word + bytes([x]) in words:
            word += bytes([x])
            continue
        codes.append((words[word], size))
        if len(words) + 2 < 4096:
            words[word + bytes([x])] = len(words) + 2
            if len(words) + 2 - 1 == 1 << size and size < 12:
                size += 1
        word = bytes([x])
    codes += [(words[word], size), (end, size)]
    bits = sum(c << s for c, s in zip([c for c, _ in codes], np.concatenate([[0], np.cumsum([s for _, s in codes])[:-1]]).tolist()))
    return bits.to_bytes((sum(s for _, s in codes) + 7) // 8, "little")


def test_gif_columns_have_timed_frames_with_colours(spark):
    def frame(delay, flags, left, top, samples, clear=0):
        body = media._blocks(media.lzw_encode(samples.reshape(-1)))
        return b"\x21\xf9\x04" + struct.pack("<BHBB", flags, delay, clear, 0) + b"\x2c" + struct.pack("<HHHHB", left, top, samples.shape[1], samples.shape[0], 0) + b"\x08" + body

    palette = bytes(x for i in range(256) for x in (255 if i == 1 else 0, 255 if i == 2 else 0, 255 if i == 3 else 0))
    head = b"GIF89a" + struct.pack("<HHBBB", 4, 4, 0xF7, 0, 0) + palette
    one, two = np.full((4, 4), 1, np.uint8), np.array([[2, 9], [9, 3]], np.uint8)
    data = head + frame(5, 1 << 2, 0, 0, one) + frame(7, 2 << 2 | 1, 1, 1, two, 9) + frame(9, 1 << 2 | 1, 0, 0, np.full((4, 4), 9, np.uint8), 9) + b"\x3b"
    table = spark.createDataFrame([(1, bytearray(data)), (2, None), (3, bytearray(b"no gif"))], "id long, gif binary").withColumn("frames", F.lit(1))
    rows = {r["id"]: r["frames"] for r in media.gif_columns(table, ["id"]).collect()}
    assert rows[2] is None and rows[3] is None and [(f["start_ms"], f["delay_ms"], f["left"], f["top"], f["width"], f["height"]) for f in rows[1]] == [(0, 50, 0, 0, 4, 4), (50, 70, 1, 1, 2, 2), (120, 90, 0, 0, 4, 4)]
    assert [(f["red"][15], f["green"][15], f["blue"][15]) for f in rows[1]] == [(16, 0, 0), (2, 1, 1), (12, 0, 0)]  # transparent pixels show; what was drawn is cleared


def test_media_columns(spark, texts, odd, none):
    for r in media.op4_media(spark, SF).collect():
        raw = texts[r["doc_id"]].encode()
        payload = raw + b" " * (-len(raw) % 192 or (192 if not raw else 0))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-16:])
    rows = media.media_columns(odd).collect()
    assert len(rows) == 9 and len({tuple(r)[1:] for r in rows if r["doc_id"] in (1, 4)}) == 1 and media.media_columns(none).count() == 0


# ---- 5


def plain_scan(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))
    places = {}
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.setdefault(label, []).append(i)
    norm, found = " " + " ".join(words) + " ", []
    for rank, priority, keyword, pattern, label in licenses.rules():
        if re.search(" (?:" + "|".join(licenses.GATE) + ") ", norm) and f" {keyword}" in norm:
            for m in re.finditer(pattern, norm):
                first = norm[: m.start()].count(" ")
                found.append((first, first + m[0].count(" ") - 1, priority, rank, label))
    kept = [x for x in found if not any(y[0] <= x[0] and y[1] >= x[1] and (y[2], y[1] - y[0], -y[3]) > (x[2], x[1] - x[0], -x[3]) for y in found)]
    starts = [i for s in places.values() for i in s]
    labels = sorted(set(places) | {k[4] for k in kept})
    score = max([k[2] / 100 for k in kept] + [0.6 if starts else 0.0])
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(places)), ",".join(labels), score


def test_licenses_equal_plain_python(spark, texts, odd, none):
    more = ["MIT License mit-license, mit license", "SPDX-License-Identifier: GPL-3.0-only", "under the GNU Lesser General Public License, version 3 or the Mozilla Public License 2.0", "Licensed under the Apache License, Version 2.0 (the License); Copyright 2020", "mit Lizenz license", "general public license " * 3, "CC BY-NC-SA 4.0 and cc by 4.0"]
    table = spark.createDataFrame([(i, t) for i, t in enumerate([*texts.values(), *more])], "doc_id long, text string")
    for r in licenses.scan(table).collect():
        text = [*texts.values(), *more][r["doc_id"]]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"]) == plain_scan(text)
    assert len(licenses.rules()) > 200
    rows = {r["doc_id"]: r for r in licenses.scan(odd).collect()}
    assert rows[None]["base_labels"] == "mit" and rows[2]["n_words"] == rows[5]["n_words"] == 0 and rows[6]["n_words"] == 12000
    assert licenses.scan(none).count() == 0


def test_licenses_in_a_long_text_of_hits(spark):
    unit = "Copyright 2020 MIT License, "
    table = spark.createDataFrame([(1, unit * 75_000), (2, unit * 300), (3, "all rights reserved " * 40 + "SPDX-License-Identifier: MIT " * 50)], "doc_id long, text string")
    began = time.time()
    rows = {r["doc_id"]: r for r in licenses.scan(table).withColumn("n", F.size("detections")).drop("detections").collect()}
    assert time.time() - began < 60  # seconds even on a slow machine; pairs of detections would take over an hour
    assert (rows[1]["n_words"], rows[1]["n_base"], rows[1]["last_word"], rows[1]["n"]) == (300_000, 75_000, 299_998, 150_000)
    for i, text in ((2, unit * 300), (3, "all rights reserved " * 40 + "SPDX-License-Identifier: MIT " * 50)):
        assert tuple(rows[i][c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")) == plain_scan(text)


def alternatives(tree):
    """One text for each way through an expression; a set of characters gives each of its first ones."""
    out = [""]
    for op, arg in tree:
        match str(op):
            case "LITERAL":
                some = [chr(arg)]
            case "IN":
                some = [chr(x if str(kind) == "LITERAL" else x[0]) for kind, x in arg]
            case "SUBPATTERN":
                some = alternatives(arg[3])
            case "BRANCH":
                some = [x for branch in arg[1] for x in alternatives(branch)]
            case "MAX_REPEAT":
                low, high, sub = arg
                some = [x * n for x in alternatives(sub) for n in sorted({low, high})]
        out = [x + y for x in out for y in dict.fromkeys(some)]
    return out


def test_license_prefilter_loses_nothing(spark, monkeypatch):
    names = [x for _, name, _ in licenses.FAMILIES.values() for x in alternatives(_parser.parse(name))]
    texts = names + [f"licensed under {x}" for x in names] + [x for _, text, _ in licenses.TEXTS for x in alternatives(_parser.parse(text))]
    texts += ["Unauthorized copying of this file is strictly prohibited", "Creative Commons Attribution-NonCommercial", "Creative Commons Attribution 4.0", "CC Attribution-Share Alike", "for noncommercial use only"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(map(tuple, licenses.scan(table).drop("detections").collect()))
    every = [(i, priority, "", pattern, label) for i, priority, _, pattern, label in licenses.rules()]
    monkeypatch.setattr(licenses, "rules", lambda: every)
    monkeypatch.setattr(licenses, "GATE", ("[^ ]+",))
    assert got == sorted(map(tuple, licenses.scan(table).drop("detections").collect()))


# ---- 6


def test_quality_on_held_out_labels(spark):
    rows = quality.op6_quality(spark, "/root/testdata/sf0.01")
    known = rows.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("crc32(cast(cast(doc_id AS string) AS binary)) % 3 = 1")
    table = {(r["quality"], r["keep"]): r["count"] for r in known.groupBy("quality", "keep").count().collect()}
    assert table.get((0, 1), 0) == 0 and table.get((1, 0), 0) <= 0.02 * table[(1, 1)]


def test_sparse_sites_shrink_toward_their_parents(spark):
    rows = [("big", "big/a", 5.0)] * 400 + [("big", "big/b", -5.0)] + [("tiny", "tiny/a", -5.0)]
    rates = {r["path"]: r for r in quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, evidence double"), 0.5).collect()}
    assert rates["big/a"]["path_rate"] > rates["big/b"]["path_rate"] > 0.2
    assert rates["tiny/a"]["path_rate"] > 0.05 and rates["tiny/a"]["host_rate"] < rates["big/a"]["host_rate"]


def test_quality_odd_rows(odd, none, labels):
    assert quality.quality(odd, labels, ["doc_id"]).count() == 9
    assert quality.keep_good(odd, labels).columns == odd.columns
    assert quality.keep_good(odd, labels.limit(0)).count() == 9 and quality.quality(none, labels, ["doc_id"]).count() == 0


# ---- 7


def test_lm_base_and_model(spark, texts):
    tokens = {i: WORD.findall(t.translate(LOWER)) + [None] for i, t in texts.items()}
    counts = collections.Counter(w for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in t)
    total, distinct = sum(counts.values()), len(counts)
    held = [0.0, 0.0]
    for r in lm.op7_lm(spark, SF).collect():
        t = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(counts[w] > 0 for w in t), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in t))
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2) and r["score"] < 0
        if r["held_out"]:
            held[0] += r["base_score"]
            held[1] += r["score"]
    assert held[1] > held[0]


class PlainModel:
    """Deleted interpolation with dictionaries: counts of triples, pairs and words, buckets by context count, EM on a fold."""

    def __init__(self, rows):
        part = {i: zlib.crc32(str(i).encode()) % 7 for i, _ in rows}
        self.learned = [self.tokens(t) for i, t in rows if part[i] != 2]
        fold = [self.tokens(t) for i, t in rows if part[i] == 0]
        self.count(self.learned)
        self.uniform = 1 / (len(self.one) + 1)
        self.count([self.tokens(t) for i, t in rows if part[i] not in (0, 2)])
        cells = collections.defaultdict(list)
        for text in fold:
            for u, v, w in self.triples(text):
                bucket, p = self.parts(u, v, w)
                cells[bucket].append([0 if not x else 2 ** (-round(-2 * math.log2(x)) / 2) for x in p[:3]] + [self.uniform])
        self.shares = {}
        for bucket, ps in cells.items():
            w = self.normal(bucket, (0.4, 0.3, 0.2, 0.1))
            for _ in range(60):
                gained = [0.0] * 4
                for p in ps:
                    whole = sum(a * b for a, b in zip(w, p))
                    gained = [g + a * b / whole for g, a, b in zip(gained, w, p)]
                w = self.normal(bucket, [g + 1e-3 for g in gained])
            self.shares[bucket] = w
        self.count(self.learned)

    @staticmethod
    def tokens(text):
        return WORD.findall((text or "").translate(LOWER)) + ["</s>"]

    @staticmethod
    def triples(text):
        return zip(["<0>", "<1>", *text], ["<1>", *text], text)

    def count(self, texts):
        self.one, self.two, self.three = collections.Counter(), collections.Counter(), collections.Counter()
        for t in texts:
            for u, v, w in self.triples(t):
                self.one[w] += 1
                self.two[v, w] += 1
                self.three[u, v, w] += 1
        self.n, self.texts = sum(self.one.values()), len(texts)

    def parts(self, u, v, w):
        word = self.texts if v == "<1>" else self.one[v]
        pair = self.texts if v == "<1>" else self.two[u, v]
        bucket = ("pair", int(math.log2(pair))) if pair else ("word", int(math.log2(word))) if word else ("none", 0)
        return bucket, [self.three[u, v, w] / max(1, pair), self.two[v, w] / max(1, word), self.one[w] / max(1, self.n), self.uniform]

    @staticmethod
    def normal(bucket, w):
        some = {"pair": (1, 1, 1, 1), "word": (0, 1, 1, 1), "none": (0, 0, 1, 1)}[bucket[0]]
        w = [a * b for a, b in zip(w, some)]
        return [x / sum(w) for x in w]

    def probability(self, u, v, w):
        bucket, p = self.parts(u, v, w)
        alike = [b for b in self.shares if b[0] == bucket[0]]
        w = self.shares[min(alike, key=lambda b: (abs(b[1] - bucket[1]), b[1]))] if alike else self.normal(bucket, (0.4, 0.3, 0.2, 0.1))
        return sum(a * b for a, b in zip(w, p))

    def score(self, text):
        return sum(math.log10(self.probability(*x)) for x in self.triples(self.tokens(text)))


def test_lm_equals_plain_python_and_sums_to_one(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"W{min(int(x), 400)}" for x in rng.zipf(1.4, size=rng.integers(1, 60)))) for i in range(300)]
    rows += [(900 + i, rows[7][1]) for i in range(12)] + [(950, None), (951, "never seen words at all")]
    plain = PlainModel(rows)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lm.score(table).collect()}
    assert got == pytest.approx({i: plain.score(t) for i, t in rows})
    many = {r["doc_id"]: r["score"] for r in lm.score(table.repartition(4), block_bytes=200).collect()}
    assert got == pytest.approx(many)
    contexts = [("<0>", "<1>"), ("<1>", "w1"), ("w1", "w1"), ("w1", "w2"), ("w9", "w1"), ("w1", "none"), ("none", "w1"), ("none", "none")]
    assert {plain.parts(u, v, "w1")[0][0] for u, v in contexts} == {"pair", "word", "none"}
    for u, v in contexts:
        assert sum(plain.probability(u, v, w) for w in [*plain.one, "unknown"]) == pytest.approx(1.0)


def test_lm_without_training_rows_is_uniform(spark):
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2]
    got = lm.score(spark.createDataFrame([(i, "some words") for i in held], "doc_id long, text string")).collect()
    assert got and all((r["score"], r["base_score"], r["train_tokens"]) == (0.0, 0.0, 0) for r in got)


def test_lm_odd_rows(odd, none):
    rows = {r["doc_id"]: r for r in lm.score(odd).collect()}
    assert rows[2]["n_tokens"] == rows[5]["n_tokens"] == 1 and rows[None]["held_out"] and rows[6]["n_tokens"] == 12001
    assert lm.score(none).count() == 0


# ---- 8


def plain_classes(rows):
    import xxhash

    def fp(text):
        w = WORD.findall((text or "").translate(LOWER))
        s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [fp(t) for _, t in rows]
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(((doc, f"{fps[i]:016x}", least.get(find(i))) for i, (doc, _) in enumerate(rows)), key=str)


def test_simhash_classes_equal_plain_python(spark, docs, texts):
    got = simhash.op8_simhash(spark, SF).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == plain_classes(list(texts.items()))


def test_links_equal_all_pairs_in_dense_groups(spark):
    rng = np.random.default_rng(4)
    seeds = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = set()
    for s in seeds:
        for _ in range(30):
            flip = 0
            for b in rng.choice(64, rng.integers(0, 7), replace=False):
                flip |= 1 << int(b)
            fps.add(int(s) ^ flip)
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    table = spark.createDataFrame([(x,) for x in signed], "fp long")
    for block in (simhash.BLOCK, 7):
        edges = simhash.links(table, block)
        roots = {r["node"]: r["root"] for r in simhash.connected_components(edges).collect()}
        x = np.array(signed, np.int64).view(np.uint64)
        near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 4
        for i, j in zip(*np.nonzero(np.triu(near, 1))):
            assert roots[signed[i]] == roots[signed[j]]
        assert all((int(r["a"]) ^ int(r["b"])) & (2**64 - 1) and bin((r["a"] ^ r["b"]) & (2**64 - 1)).count("1") <= 4 for r in edges.collect())


def test_simhash_odd_rows(odd, none):
    rows = simhash.classes(odd).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in rows if r["doc_id"] is not None) == [(1, 1), (2, 2), (3, 2), (4, 1), (4, 1), (5, 2), (6, 6), (7, 7)]
    kept = simhash.drop_near_duplicates(odd)
    assert sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()) == [1, 2, 6, 7] and kept.columns == odd.columns
    assert simhash.classes(none).count() == 0


def test_near_duplicates_keep_one_row_of_each_class(spark):
    rng = np.random.default_rng(5)
    unlike = [" ".join(f"w{x}" for x in rng.integers(0, 10**9, 40)) for _ in range(60)]
    rows = [(None, x) for x in unlike[:30]] + [(5, x) for x in unlike[30:50]] + [(5, unlike[50]), (6, unlike[50]), (None, unlike[50]), (4, unlike[51]), (None, unlike[51]), (7, unlike[31])]
    rows += [(None, x) for x in unlike[:3]] + [(None, unlike[52])] * 3 + [(8, None), (8, ""), (None, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("hash", F.lit("clash"))
    for part in (docs, docs.orderBy(F.col("text").desc())):
        kept = simhash.drop_near_duplicates(part)
        assert kept.columns == docs.columns
        got = sorted(((r["doc_id"], r["text"] or "") for r in kept.collect()), key=str)
        assert got == sorted([(None, x) for x in unlike[:30]] + [(5, x) for x in unlike[30:51]] + [(4, unlike[51]), (None, unlike[52]), (8, "")], key=str)


def shingle_sets(text):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_roots(texts, similarity=0.8):
    """Classes by shared five-word shingles of all pairs, without fingerprints, keys or groups."""
    sets, holders, roots = [shingle_sets(t) for t in texts], collections.defaultdict(list), list(range(len(texts)))

    def root(i):
        while roots[i] != i:
            i = roots[i]
        return i

    for i, own in enumerate(sets):
        shared = collections.Counter(j for x in (own or {()}) for j in holders[x])
        for j, n in shared.items():
            if not own or n / (len(own) + len(sets[j]) - n) >= similarity:
                a, b = sorted((root(i), root(j)))
                roots[b] = a
        for x in own or {()}:
            holders[x].append(i)
    return [root(i) for i in range(len(texts))]


def test_counted_shingles_equal_all_pairs():
    rng = np.random.default_rng(9)
    made = ["", " ", "a", "a b", "A  b", "a b c d e", "a b c d e a b c d e"]
    for _ in range(60):
        base = rng.integers(0, 400, rng.integers(5, 60)).tolist()
        for _ in range(rng.integers(1, 6)):
            made.append(" ".join(f"w{x if rng.random() > 0.03 else rng.integers(400, 900)}" for x in base))
    raw = [t.encode() for t in made]
    for similarity in (0.5, 0.8, 1.0):
        got = simhash.shared_roots(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), similarity)
        want = plain_roots(made[2:], similarity)
        assert got.tolist() == [0, 1, *(x + 2 for x in want)]


@pytest.mark.parametrize("block", [simhash.TEXT_BLOCK, 5])
def test_near_duplicates_of_large_groups_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "TEXT_BLOCK", block)
    rng = np.random.default_rng(10)
    made, text = [], [f"w{i}" for i in range(200)]
    for _ in range(40):  # a chain: neighbours are alike, its ends are not
        made.append(" ".join(text))
        text[int(rng.integers(200))] = f"n{rng.integers(10**6)}"
    made += [" ".join(f"w{i}" if i % 9 else f"z{k}y{i}" for i in range(200)) for k in range(20)]  # below 0.8 to all
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    texts = docs.select(F.xxhash64("text").alias("node"), F.struct(*simhash.row_keys()).alias("first"))
    edges = simhash.counted_links(docs, texts, texts.select("node", F.lit(1).cast("long").alias("root")), 0.8)
    roots = {r["node"]: r["root"] for r in simhash.connected_components(edges).collect()}
    nodes = [r[0] for r in docs.select(F.xxhash64("text")).collect()]
    want = plain_roots(made)
    got = [roots.get(n, n) for n in nodes]
    assert len(set(want)) > 20 and all((got[i] == got[j]) == (want[i] == want[j]) for i in range(len(made)) for j in range(i))


def test_near_duplicates_find_planted_edits(spark, texts):
    rng = np.random.default_rng(8)
    base = [t.split() for t in sorted(set(texts.values())) if 120 <= len(t.split()) <= 900][:70]
    made = [" ".join(t) for t in base]
    for t in base:
        for _ in range(3):
            edited = list(t)
            for at in rng.choice(len(t), max(1, round(len(t) * rng.uniform(0.002, 0.02))), replace=False):
                edited[at] = f"new{rng.integers(10**6)}"
            made.append(" ".join(edited))
    hub = [f"h{i}" for i in range(300)]  # a large group of near copies, with other distances to each other
    for i in range(150):
        edited = list(hub)
        for at in rng.choice(300, 3, replace=False):
            edited[at] = f"e{i}x{at}"
        made.append(" ".join(edited))
    made += ["", "one", "two", "one two three"]
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()}
    want = set(plain_roots(made))
    assert want <= kept and len(kept) <= 1.03 * len(want)  # nothing is dropped without a link; candidates may miss a few
    assert len(kept & set(range(len(base) + 3 * len(base), len(base) * 4 + 150))) == 1


def test_allowed_bits_grow_with_dissimilarity():
    assert simhash.allowed_bits(1.0) == 0 < simhash.allowed_bits(0.9) < simhash.allowed_bits(0.8) < simhash.allowed_bits(0.5) < 128


# ---- 9


def test_toxicity_on_held_out_labels(spark):
    rows = toxicity.op9_toxicity(spark, "/root/testdata/sf0.1")
    known = rows.join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out")
    table = {(r["toxic"], r["predicted"]): r["count"] for r in known.groupBy("toxic", "predicted").count().collect()}
    assert table.get((0, 1), 0) <= 0.01 * table[(0, 0)] and table[(1, 1)] >= 0.85 * (table[(1, 1)] + table.get((1, 0), 0))


def test_toxicity_odd_rows(odd, none, labels):
    model = toxicity.train(odd, toxicity.known_labels(labels))
    rows = toxicity.score(odd, model, ["doc_id"]).collect()
    assert len(rows) == 9 and all(0 <= r["toxic_score"] <= 1 for r in rows)
    assert len(toxicity.train(odd, toxicity.known_labels(labels.limit(0)))[0]) == 0
    assert toxicity.drop_toxic(odd, model).columns == odd.columns and toxicity.score(none, model, ["doc_id"]).count() == 0


def test_hashed_tokens_equal_split_words():
    import pyarrow as pa

    texts = ["A b  C", "", "x", "été a", "  b A "]
    raw, offsets = hashing.column_bytes(pa.array([t.encode() for t in texts]))
    hashes, counts = hashing.tokens(raw, offsets, hashing.NON_SPACE)
    words = [w for t in texts for w in t.translate(LOWER).split()]
    assert counts.tolist() == [len(t.split()) for t in texts]
    assert len(set(zip(words, hashes.tolist()))) == len(set(words)) == len(set(hashes.tolist()))


# ---- 10


def test_token_ids_equal_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("", "Hello  world\n\n it's 2024", "a <|endoftext|> b<|endoftext|>", "üß 中文 \U0001f600", "x" * 700):
        assert packing.token_ids(text).tolist() == [*slow.encode(text, add_special_tokens=False).ids, 2]


def check_packing(rows, capacity=1024):
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), -(-sum(r["length"] for r in rows) // capacity)


def test_packing(spark, texts):
    rows = packing.op10_packing(spark, SF).collect()
    used, least = check_packing(rows)
    assert used <= 1.03 * least + 1
    by = collections.defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    for doc, text in texts.items():
        ids, own = packing.token_ids(text), sorted(by[doc], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and sum(r["length"] for r in own) == len(ids)
        assert all(r["length"] == 1024 for r in own[1:])
        for r in own:
            assert zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_length_once(seed):
    rng = np.random.default_rng(seed)
    histogram = collections.Counter(np.clip(rng.lognormal(5.5, 1.2, 20_000).astype(int), 1, 1024).tolist())
    runs = packing.plan(dict(histogram))
    seen, load = collections.defaultdict(list), collections.Counter()
    for length, rank, count, first, offset in runs:
        seen[length].append((rank, count))
        for i in range(count):
            load[first + i] += length
            assert offset + length <= 1024
    for length, n in histogram.items():
        at = 0
        for rank, count in sorted(seen[length]):
            assert rank == at
            at += count
        assert at == n
    total = sum(k * v for k, v in histogram.items())
    assert max(load.values()) <= 1024 and len(load) <= 1.02 * total / 1024 + 1


def test_packing_odd_rows(odd, none):
    rows = packing.pack(odd).collect()
    check_packing(rows)
    assert {r["doc_id"] for r in rows} == {1, 2, 3, 4, 5, 6, 7, None} and [r["length"] for r in rows if r["doc_id"] in (2, 3)] == [1, 1]
    assert packing.pack(none).count() == 0
