"""Media columns: GIF. LZW code streams, palettes, disposal and transparency, timed frames, histograms.

``gif_encode`` stores bytes losslessly as palette indices of timed frames; ``gif_decode`` reads any GIF87a/89a:
it decodes LZW, applies global and local palettes, the disposal rules and transparency, and gives timed
RGB frames. ``media_columns`` runs both over a table.

What is stored: frames of ``MAX_ROWS`` rows on a screen of that height, each an LZW stream with dictionary
codes of 9 to 12 bits. The palette has a colour of its own for every byte (red is the byte itself). A pixel
that the screen shows already is stored as transparent, if the frame has an index to spare for that; texts in UTF-8
have one. Frames stay, give way to the background or give way to what was there before, in turn, so
what the screen shows, and with it every later frame, depends on disposal and transparency being applied.

Streams don't depend on each other, so all streams of a batch are coded side by side in numpy, one step
of every stream at a time; a decoded word is a stretch of earlier output, so words are expanded by doubling
pointers instead of copying one after the other.

Results for odd input: null text is empty and is stored as one row of padding; equal texts give equal
values; texts of any length become as many frames as they need (a row of a task holds a few times its text,
batches of streams are bounded); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns, table
from .hashing import chunks

#: The row of a frame, in samples; payloads are padded to a multiple of it.
WIDTH = 192
#: Rows of a frame at most.
MAX_ROWS = 16
DELAY_CS = 10
#: A colour for each byte: red is the byte.
COLOURS = bytes(x for i in range(256) for x in (i, 255 - i, 7 * i & 255))
#: What becomes of a frame when its time is over, in turn: 1 it stays, 2 it gives way to the background, 3 to what was there.
DISPOSALS = (1, 1, 2, 3)
#: The index of transparent pixels, where a frame has no sample of that value.
SPARE = 255
CLEAR, END = 256, 257
#: Codes between two clear codes, so that the table never fills.
GROUP = 3800
#: Bits of a code, by the codes since the last clear code.
BITS = np.array([min(12, max(9, (257 + m).bit_length())) if m else 9 for m in range(4096)], np.int64)
#: Slots of a stream's table of words, and streams coded side by side at most.
SLOTS = 8192
SIDE_BY_SIDE = 1536


def pad(raw: bytes) -> bytes:
    return raw + b" " * (-len(raw) % WIDTH or (WIDTH if not raw else 0))


def _blocks(data: bytes) -> bytes:
    full, rest = divmod(len(data), 255)
    body = np.frombuffer(data[: full * 255], np.uint8).reshape(full, 255)
    out = np.concatenate([np.full((full, 1), 255, np.uint8), body], axis=1).tobytes()
    return out + (bytes([rest]) + data[full * 255 :] if rest else b"") + b"\0"


def lzw_encode(samples: np.ndarray) -> bytes:
    """A code stream of 8-bit samples."""
    return lzw_encode_many([samples])[0]


def lzw_encode_many(samples: list[np.ndarray]) -> list[bytes]:
    """Code streams of 8-bit samples, by greedy longest words, side by side."""
    out: list[bytes] = []
    for lo in range(0, len(samples), SIDE_BY_SIDE):
        some = samples[lo : lo + SIDE_BY_SIDE]
        order = sorted(range(len(some)), key=lambda i: -len(some[i]))
        back = np.empty(len(some), np.int64)
        back[order] = np.arange(len(some))
        streams = _encode([some[i] for i in order])
        out += [streams[i] for i in back]
    return out


def _encode(samples: list[np.ndarray]) -> list[bytes]:
    """The same for a bounded number of streams, longest first."""
    lengths = np.array([len(x) for x in samples])
    most = int(lengths.max(initial=0))
    steps = np.zeros((most + 1, len(samples)), np.int32)
    for i, x in enumerate(samples):
        steps[: len(x), i] = x
    keys, words = np.full((len(samples), SLOTS), -1, np.int32), np.zeros((len(samples), SLOTS), np.int32)
    flat_keys, flat_words = keys.reshape(-1), words.reshape(-1)
    base = np.arange(len(samples), dtype=np.int64) * SLOTS
    word, since = steps[0].copy(), np.zeros(len(samples), np.int32)
    codes = np.full((most + 1, len(samples)), -1, np.int16)
    for k in range(1, most):
        n = int(np.searchsorted(-lengths, -k, "left"))
        key = word[:n] << 8 | steps[k, :n]
        slot = base[:n] + ((key.astype(np.int64) * 0x9E3779B1 >> 15) & (SLOTS - 1))
        there = flat_keys[slot]
        hit = there == key
        away = np.flatnonzero(~hit & (there >= 0))
        while len(away):
            slot[away] = base[away] + ((slot[away] + 1) & (SLOTS - 1))
            there = flat_keys[slot[away]]
            hit[away] = there == key[away]
            away = away[(there != key[away]) & (there >= 0)]
        new = np.flatnonzero(~hit)
        codes[k, new] = word[new]
        flat_keys[slot[new]] = key[new]
        flat_words[slot[new]] = 258 + since[new]
        since[new] += 1
        word[:n] = np.where(hit, flat_words[slot], steps[k, :n])
        full = new[since[new] >= GROUP]
        if len(full):
            keys[full], since[full] = -1, 0
    some = np.flatnonzero(lengths)
    codes[lengths[some], some] = word[some]
    return _pack(codes)


def _pack(codes: np.ndarray) -> list[bytes]:
    """Byte streams of the codes (not -1) in each column, least significant bit first, with clear and end codes."""
    n_streams = codes.shape[1]
    stream, _ = np.nonzero(codes.T >= 0)
    flat = codes.T[codes.T >= 0].astype(np.int64)
    counts = np.bincount(stream, minlength=n_streams)
    groups = np.maximum(1, -(-counts // GROUP))
    totals = counts + groups + 1
    starts = np.cumsum(totals) - totals
    j = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
    values, widths = np.full(int(totals.sum()), CLEAR, np.int64), np.full(int(totals.sum()), int(BITS[GROUP]), np.int64)
    at = starts[stream] + j + j // GROUP + 1
    values[at], widths[at] = flat, BITS[j % GROUP]
    widths[starts] = BITS[0]
    ends = starts + totals - 1
    values[ends], widths[ends] = END, BITS[counts - (groups - 1) * GROUP]
    bits = np.add.reduceat(widths, starts)
    sizes = -(-bits // 8)
    first = np.cumsum(sizes) - sizes
    before = np.cumsum(widths) - widths
    offset = before - np.repeat(before[starts], totals) + 8 * np.repeat(first, totals)
    shifted, byte = values << (offset & 7), offset >> 3
    total = int(sizes.sum())
    raw = sum(np.bincount(byte + i, shifted >> 8 * i & 255, total + 2) for i in range(3)).astype(np.uint8)[:total].tobytes()
    return [raw[a : a + n] for a, n in zip(first.tolist(), sizes.tolist())]


def lzw_decode_many(streams: list[bytes], lengths: list[int]) -> list[np.ndarray]:
    """Samples of code streams of 8-bit samples, so many of each, side by side; short streams are filled with 0."""
    out: list[np.ndarray] = []
    for lo in range(0, len(streams), SIDE_BY_SIDE):
        out += _decode(streams[lo : lo + SIDE_BY_SIDE], np.array(lengths[lo : lo + SIDE_BY_SIDE], np.int64))
    return out


def _decode(streams: list[bytes], lengths: np.ndarray) -> list[np.ndarray]:
    sizes = np.array([len(x) for x in streams], np.int64)
    raw = np.frombuffer(b"".join(streams) + b"\0" * 4, np.uint8).astype(np.int32)
    threes = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    first = np.cumsum(lengths) - lengths
    bit, stop = 8 * (np.cumsum(sizes) - sizes), 8 * np.cumsum(sizes)
    word_at, word_n = np.zeros(len(streams) * 4096, np.int32), np.zeros(len(streams) * 4096, np.int32)
    since, done = np.zeros(len(streams), np.int64), np.zeros(len(streams), np.int64)
    last_at, last_n = np.zeros(len(streams), np.int64), np.zeros(len(streams), np.int64)
    # Of every word put out: where, how long, and its sample or where its stretch of output begins.
    to, n_of, sample, source = [], [], [], []
    now = np.flatnonzero(lengths > 0)
    while len(now):
        width = BITS[np.minimum(since[now], 4095)]
        code = (threes[np.minimum(bit[now] >> 3, len(threes) - 1)] >> (bit[now] & 7)) & ((1 << width) - 1)
        bit[now] += width
        over = (code == END) | (bit[now] > stop[now])
        clear = (code == CLEAR) & ~over
        since[now[clear]] = 0
        use = ~(over | clear)
        some, code = now[use], code[use]
        grow = (since[some] > 0) & (since[some] < 4096 - 257)
        entry = some[grow] * 4096 + 257 + since[some[grow]]
        word_at[entry], word_n[entry] = last_at[some[grow]], last_n[some[grow]] + 1
        known = np.minimum(some * 4096 + code, len(word_n) - 1)
        plain = code < 256
        n = np.minimum(np.where(plain, 1, word_n[known]), lengths[some] - done[some])
        last_at[some], last_n[some] = done[some], n
        to.append(first[some] + done[some])
        n_of.append(n)
        sample.append(np.where(plain, code, -1))
        source.append(first[some] + word_at[known])
        since[some] += 1
        done[some] += n
        over[use] |= done[some] >= lengths[some]
        now = now[~over]
    total = int(lengths.sum())
    at, values = np.arange(total, dtype=np.int64), np.zeros(total, np.uint8)
    if to:
        to, n_of, sample, source = (np.concatenate(x) for x in (to, n_of, sample, source))
        plain = (sample >= 0) & (n_of > 0)
        values[to[plain]] = sample[plain]
        to, n_of, source = to[sample < 0], n_of[sample < 0], source[sample < 0]
        inner = np.arange(int(n_of.sum())) - np.repeat(np.cumsum(n_of) - n_of, n_of)
        at[np.repeat(to, n_of) + inner] = np.repeat(source, n_of) + inner
        while True:
            further = at[at]
            if np.array_equal(further, at):
                break
            at = further
    flat = values[at]
    return [flat[a : a + n] for a, n in zip(first.tolist(), lengths.tolist())]


def lzw_decode(data: bytes, min_size: int, n: int) -> np.ndarray:
    """``n`` samples of a code stream; short streams are filled with 0."""
    if min_size == 8:
        return lzw_decode_many([data], [n])[0]
    clear, end = 1 << min_size, (1 << min_size) + 1
    base = [bytes([i]) for i in range(clear)] + [b"", b""]
    words, size, out, got, last, bits, held = list(base), min_size + 1, [], 0, None, 0, 0
    for byte in data:
        held |= byte << bits
        bits += 8
        while bits >= size:
            code, held, bits = held & ((1 << size) - 1), held >> size, bits - size
            if code == clear:
                words, size, last = list(base), min_size + 1, None
                continue
            if code == end or got >= n:
                bits, data = -1, b""
                break
            if last is None:
                word = words[code] if code < len(words) else b""
            elif code < len(words):
                word = words[code]
            else:
                word = last + last[:1]
            if last is not None and len(words) < 4096:
                words.append(last + word[:1])
                if len(words) == 1 << size and size < 12:
                    size += 1
            out.append(word)
            got += len(word)
            last = word
        if bits < 0:
            break
    flat = np.frombuffer(b"".join(out)[:n], np.uint8)
    return np.concatenate([flat, np.zeros(n - len(flat), np.uint8)])


def stored_frames(payload: bytes, width: int = WIDTH, max_rows: int = MAX_ROWS) -> Iterator[tuple[np.ndarray, int, bool]]:
    """Indices, disposal and whether ``SPARE`` is transparent, for each frame."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, width)
    screen, shown = np.zeros((min(len(samples), max_rows), width), np.uint8), np.zeros((min(len(samples), max_rows), width), bool)
    for i, top in enumerate(range(0, len(samples), max_rows)):
        own, disposal = samples[top : top + max_rows], DISPOSALS[i % len(DISPOSALS)]
        n, spare = len(own), not (own == SPARE).any()
        yield np.where(shown[:n] & (screen[:n] == own), SPARE, own).astype(np.uint8) if spare else own, disposal, spare
        if disposal == 1:
            screen[:n], shown[:n] = own, True
        elif disposal == 2:
            shown[:n] = False


def gif_encode(payload: bytes, width: int = WIDTH, max_rows: int = MAX_ROWS, delay_cs: int = DELAY_CS) -> bytes:
    """An animation whose palette indices, as shown, are the payload's bytes, row by row."""
    return gif_encode_many([payload], width, max_rows, delay_cs)[0]


def gif_encode_many(payloads: list[bytes], width: int = WIDTH, max_rows: int = MAX_ROWS, delay_cs: int = DELAY_CS) -> list[bytes]:
    frames = [list(stored_frames(x, width, max_rows)) for x in payloads]
    streams = iter(lzw_encode_many([indices.reshape(-1) for own in frames for indices, *_ in own]))
    out = []
    for payload, own in zip(payloads, frames):
        parts = [b"GIF89a", struct.pack("<HHBBB", width, min(len(payload) // width, max_rows), 0xF7, 0, 0), COLOURS]
        for indices, disposal, spare in own:
            parts += [b"\x21\xf9\x04", struct.pack("<BHBB", disposal << 2 | spare, delay_cs, SPARE if spare else 0, 0), b"\x2c", struct.pack("<HHHHB", 0, 0, width, len(indices), 0), b"\x08"]
            parts.append(_blocks(next(streams)))
        out.append(b"".join([*parts, b"\x3b"]))
    return out


def _sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    out = []
    while at < len(data) and (n := data[at]):
        out.append(data[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(out), at + 1


def gif_frames(data: bytes) -> Iterator[dict]:
    """Frames as stored: delay, place, palette, transparent index, disposal, indices."""
    for f in _read_frames(data):
        yield f | {"indices": _in_order(f, lzw_decode(f["stream"], f["min_size"], f["size"][0] * f["size"][1]))}


def _in_order(frame: dict, samples: np.ndarray) -> np.ndarray:
    """Samples as rows, interlace undone."""
    h, w = frame["size"]
    indices = samples.reshape(h, w)
    if not frame["interlaced"]:
        return indices
    order = np.concatenate([np.arange(s, h, d) for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))])
    plain = np.empty_like(indices)
    plain[order] = indices
    return plain


def _read_frames(data: bytes) -> Iterator[dict]:
    """Frames with their code streams."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at, shared = 13, b""
    if flags & 0x80:
        shared, at = data[13 : 13 + 3 * (2 << (flags & 7))], 13 + 3 * (2 << (flags & 7))
    delay, clear_index, disposal = 0, -1, 0
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            label, (body, at) = data[at + 1], _sub_blocks(data, at + 2)
            if label == 0xF9:
                disposal, delay = body[0] >> 2 & 7, struct.unpack_from("<H", body, 1)[0]
                clear_index = body[3] if body[0] & 1 else -1
            continue
        left, top, w, h, own = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        palette = shared
        if own & 0x80:
            palette, at = data[at : at + 3 * (2 << (own & 7))], at + 3 * (2 << (own & 7))
        stream, after = _sub_blocks(data, at + 1)
        min_size, at = data[at], after
        yield {"screen": (width, height), "delay_cs": delay, "left": left, "top": top, "palette": np.frombuffer(palette, np.uint8).reshape(-1, 3), "clear_index": clear_index, "disposal": disposal, "size": (h, w), "interlaced": bool(own & 0x40), "min_size": min_size, "stream": stream}
        delay, clear_index, disposal = 0, -1, 0


def gif_decode(data: bytes) -> Iterator[dict]:
    """Timed frames as shown: start_cs, delay_cs, rgb (screen high and wide), shown (pixels set so far), place."""
    yield from show(gif_frames(data))


def gif_decode_many(gifs: list[bytes]) -> Iterator[Iterator[dict]]:
    """``gif_decode`` of each, their code streams of 8-bit samples decoded side by side."""
    read = [list(_read_frames(x)) for x in gifs]
    wide = [f for own in read for f in own if f["min_size"] == 8]
    samples = iter(lzw_decode_many([f["stream"] for f in wide], [f["size"][0] * f["size"][1] for f in wide]))
    for own in read:
        yield show([f | {"indices": _in_order(f, next(samples) if f["min_size"] == 8 else lzw_decode(f["stream"], f["min_size"], f["size"][0] * f["size"][1]))} for f in own])


def show(frames) -> Iterator[dict]:
    """Draws stored frames one after the other."""
    canvas, start = None, 0
    for f in frames:
        width, height = f["screen"]
        if canvas is None:
            canvas, shown = np.zeros((height, width, 3), np.uint8), np.zeros((height, width), bool)
        before = (canvas.copy(), shown.copy()) if f["disposal"] == 3 else None
        idx = f["indices"]
        box = np.s_[f["top"] : min(height, f["top"] + idx.shape[0]), f["left"] : min(width, f["left"] + idx.shape[1])]
        idx = idx[: canvas[box].shape[0], : canvas[box].shape[1]]
        palette = np.zeros((256, 3), np.uint8)
        palette[: len(f["palette"])] = f["palette"]
        if f["clear_index"] < 0:
            canvas[box], shown[box] = palette[idx], True
        else:
            drawn = idx != f["clear_index"]
            canvas[box][drawn], shown[box][drawn] = palette[idx[drawn]], True
        yield {"start_cs": start, "delay_cs": f["delay_cs"], "rgb": canvas, "shown": shown, "box": box}
        start += f["delay_cs"]
        if f["disposal"] == 2:
            canvas[box], shown[box] = 0, False
        elif before:
            canvas, shown = before


FRAME = "array<struct<start_ms:int,delay_ms:int,left:int,top:int,width:int,height:int,red:array<int>,green:array<int>,blue:array<int>>>"


def frame_columns(frame: dict, bins: int = 16) -> dict:
    """A timed frame as a struct: when and where it is drawn, and colour histograms of that part of the screen as shown."""
    part, (rows, columns) = frame["rgb"][frame["box"]], frame["box"]
    grey = np.array_equal(part[..., 0], part[..., 1]) and np.array_equal(part[..., 1], part[..., 2])
    red, green, blue = (np.bincount(part[..., 0 if grey else c].reshape(-1) >> 4, minlength=bins).tolist() if not grey or not c else None for c in range(3))
    place = {"left": columns.start, "top": rows.start, "width": part.shape[1], "height": part.shape[0]}
    return {"start_ms": 10 * frame["start_cs"], "delay_ms": 10 * frame["delay_cs"], **place, "red": red, "green": green or red, "blue": blue or red}


def gif_columns(media: DataFrame, keep: list[str], gif_col: str = "gif") -> DataFrame:
    """``keep`` and frames: the timed frames of a column of GIFs with their histograms; null for null and for what is no GIF."""

    def run(batch):
        gifs = batch.column("_gif").to_pylist()
        fine = [x is not None and x[:6] in (b"GIF87a", b"GIF89a") for x in gifs]
        shown = gif_decode_many([x for x, ok in zip(gifs, fine) if ok])
        return [[[frame_columns(f) for f in next(shown)] if ok else None for ok in fine]]

    rows = media.select(*keep, F.col(gif_col).alias("_gif"))
    return map_columns(rows, keep, f"frames {FRAME}", run)


#: Bytes of texts that are coded side by side, about.
PART_BYTES = 8 << 20


def describe(texts: list[bytes]) -> Iterator[tuple]:
    """What is read back from the stored form of each text, and its frames."""
    payloads = [pad(x) for x in texts]
    stored = gif_encode_many(payloads)
    for raw, payload, media, shown in zip(texts, payloads, stored, gif_decode_many(stored)):
        back, frames = [], []
        for f in shown:
            back.append(f["rgb"][f["box"]][..., 0].tobytes())
            frames.append(frame_columns(f))
        read, hist = b"".join(back), np.sum([f["red"] for f in frames], axis=0)
        feature = f"frames={len(frames)};ms={sum(f['delay_ms'] for f in frames)};size={WIDTH}x{len(payload) // WIDTH};hist=" + "-".join(map(str, hist.tolist()))
        yield len(raw), len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, frames


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frames: bool = False) -> DataFrame:
    """Stores each text as a GIF, reads the stored bytes back and describes what was read; with ``frames`` also every timed frame with its histograms."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw"))
    fields = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + f", frames {FRAME}" * frames

    def run(batch):
        raw, sizes = batch.column("raw").to_pylist(), np.cumsum([0] + [len(x) for x in batch.column("raw").to_pylist()])
        out = [x for lo, hi in chunks(sizes, PART_BYTES) for x in describe(raw[lo:hi])]
        return list(zip(*out))[: 7 + frames] or [[]] * (7 + frames)

    return map_columns(rows, ["doc_id"], fields, run)


def op4_media(spark, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"), frames=True)
