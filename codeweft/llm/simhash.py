"""SimHash near-duplicates with pigeonring filtering.

A 64-bit fingerprint is a majority vote over the hashes of a text's word shingles. Fingerprints link
at ``max_bits`` (4) or fewer differing bits. Cut into five segments on a ring, every linked pair has a
segment from which each chain of l segments differs in at most l * 4 / 5 bits: none in the first,
one in the first two, two in three, three in four. So candidates share a whole segment and half of
the next one; a bucket then checks the chain's budgets step by step, and the full Hamming distance last.

Equal fingerprints are grouped before the search. A bucket gives only a spanning forest of its links;
large buckets are searched as pairs of blocks, so that no task holds an unbounded bucket and no group
emits all its pairs. Components of the links are the classes.

Results for odd input: null and blank texts have fingerprint zero and link like any other; texts of
fewer than four words hash as one shingle; repeated rows are in one class; rows with a null id are
in their class but never its id (null if alone); an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns, pinned, table
from .components import connected_components
from .hashing import LOWER, NON_SPACE, chunks, column_bytes, mixed, pair, tokens

SHINGLE = 4
MAX_BITS = 4
SEED = 42
#: Bits of the five segments, from the least significant.
WIDTHS = (13, 13, 13, 13, 12)
#: Fingerprints of a bucket's block.
BLOCK = 2_048
#: Classes of at most so many frequent fingerprints are broadcast; all others are joined by shuffle.
HOT_FINGERPRINTS = 1_000
#: Groups of at most so many fingerprints are compared in bulk.
SMALL = 24
LOWER_TABLE = LOWER.tobytes()


def fingerprint(text: bytes, size: int = SHINGLE, seed: int = SEED) -> int:
    from xxhash import xxh64_intdigest

    words = text.translate(LOWER_TABLE).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    stops = ends[size - 1 :].tolist() if len(words) >= size else [len(joined)]
    hashes = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, stops)], ">u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4_096):
        ones += np.unpackbits(hashes[at : at + 4_096].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its fingerprint as a signed long."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_raw"))
    return map_columns(rows, ["doc_id"], "fp long", lambda batch: [[fingerprint(x) for x in batch.column("_raw").to_pylist()]])


def _segments() -> list[tuple[int, int]]:
    return [(sum(WIDTHS[:i]), w) for i, w in enumerate(WIDTHS)]


def candidate_keys(fps: DataFrame) -> DataFrame:
    """fp and its ten keys: chain start, half, the whole first segment and half of the second."""
    cut = _segments()

    def bits(at: int, width: int):
        return F.shiftrightunsigned(F.col("fp"), at).bitwiseAND(F.lit((1 << width) - 1))

    keys = []
    for i, (at, width) in enumerate(cut):
        after, wide = cut[(i + 1) % len(cut)]
        for half, (low, n) in enumerate(((after, wide // 2), (after + wide // 2, wide - wide // 2))):
            keys.append(F.lit((2 * i + half) << 40) + bits(at, width) * (1 << 16) + bits(low, n))
    return fps.select("fp", F.explode(F.array(*keys)).alias("key"))


def _chain_masks(i: int) -> list[np.uint64]:
    """Bits of the first two, three and four segments of the chain from segment i."""
    cut, mask, out = _segments(), 0, []
    for l in range(4):
        at, width = cut[(i + l) % len(cut)]
        mask |= ((1 << width) - 1) << at
        out.append(np.uint64(mask))
    return out[1:]


def _linked(x: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Whether differences ``x`` keep the budgets of their chains (rows of ``masks``) and the whole budget."""
    ok = np.bitwise_count(x & masks[..., 0]) <= 1
    at = np.flatnonzero(ok)
    for step, budget in ((1, 2), (2, 3), (None, MAX_BITS)):
        if step is None:
            at = at[np.bitwise_count(x[at]) <= budget]
        else:
            at = at[np.bitwise_count(x[at] & masks[at, step]) <= budget]
    out = np.zeros(len(x), bool)
    out[at] = True
    return out


def _forest(fps: np.ndarray, masks: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links in one large group."""
    open_, edges = np.arange(1, len(fps)), []
    frontier = [0]
    while True:
        while frontier and len(open_):
            at = frontier.pop()
            hit = _linked(fps[open_] ^ fps[at], np.broadcast_to(masks, (len(open_), 3)))
            edges += [(at, int(b)) for b in open_[hit]]
            frontier += open_[hit].tolist()
            open_ = open_[~hit]
        if not len(open_):
            return edges
        frontier, open_ = [int(open_[0])], open_[1:]


_MASKS = np.array([_chain_masks(i) for i in range(len(WIDTHS))], np.uint64)


def group_links(keys: np.ndarray, fps: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within groups: rows ends[i-1]..ends[i] are group i; keys name the chain's start."""
    starts = np.concatenate([[0], ends[:-1]])
    sizes = ends - starts
    left, right = [], []
    for size in np.unique(sizes[(sizes > 1) & (sizes <= SMALL)]):
        i, j = np.triu_indices(size, 1)
        some = starts[sizes == size]
        step = max(1, 500_000 // len(i))
        for lo in range(0, len(some), step):
            base = some[lo : lo + step, None]
            a, b = (base + i).reshape(-1), (base + j).reshape(-1)
            ok = _linked(fps[a] ^ fps[b], _MASKS[keys[a] >> 41])
            left.append(fps[a[ok]])
            right.append(fps[b[ok]])
    for s, e in zip(starts[sizes > SMALL], ends[sizes > SMALL]):
        pairs = np.array(_forest(fps[s:e], _MASKS[keys[s] >> 41]), np.int64).reshape(-1, 2)
        left.append(fps[s:e][pairs[:, 0]])
        right.append(fps[s:e][pairs[:, 1]])
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *left]).view(np.int64), np.concatenate([none, *right]).view(np.int64)


def _search(batches):
    """Sorted rows (key, a, b, fp) of whole groups to links; a group may span batches."""
    names = ["key", "block_a", "block_b"]

    def found(rows: pd.DataFrame):
        group = rows[names].to_numpy()
        ends = np.append(np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1, len(rows)).astype(np.int64)
        a, b = group_links(rows["key"].to_numpy(), rows["fp"].to_numpy().view(np.uint64), ends)
        return pd.DataFrame({"a": a, "b": b}).drop_duplicates()

    held = None
    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if not len(rows):
            continue
        last = (rows[names] == rows[names].iloc[-1]).all(axis=1).to_numpy()
        first = int(np.argmax(last))
        held = rows.iloc[first:].reset_index(drop=True)
        if first:
            yield found(rows.iloc[:first])
    if held is not None:
        yield found(held)


def links(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints in ``fps`` as all links would."""
    keyed = candidate_keys(fps)
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / block).alias("blocks"))
    rows = keyed.join(shared, "key").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("own", "other").alias("block_a"), F.greatest("own", "other").alias("block_b"), "fp")
    groups = ["key", "block_a", "block_b"]
    n = max(1, int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(n, *groups).sortWithinPartitions(*groups, "fp").mapInPandas(_search, "a long, b long")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id (the smallest id of the class) for each row."""
    own = pinned(fingerprints(docs, id_col, text_col), "simhash-docs")
    least = pinned(own.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("n")), "simhash-fps")
    roots = connected_components(links(least.select("fp")))
    rooted = least.join(roots, least["fp"] == roots["node"]).select("fp", "root", "least_id")
    of_root = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    linked = rooted.select("fp", "root").join(of_root, "root").select("fp", "component_id")
    class_of = pinned(least.join(linked, "fp", "left").select("fp", "n", F.coalesce("component_id", "least_id").alias("component_id")), "simhash-classes")
    # Fingerprints that each hold more than a share of all rows are at most that many: these may be broadcast.
    often = max(50.0, own.count() / HOT_FINGERPRINTS)
    hot = F.broadcast(class_of.where(F.col("n") > often).select("fp", "component_id"))
    rare = class_of.where(F.col("n") <= often).select("fp", "component_id")
    spread = own.join(hot, "fp").union(own.join(hot.select("fp"), "fp", "left_anti").join(rare, "fp").select("fp", "doc_id", "component_id"))
    return spread.select("doc_id", "fp", "component_id")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---- near-duplicate rows of a table: candidates by fingerprints, links by counted five-word shingles

ROW_SHINGLE, SIMILARITY = 5, 0.8
#: Bits of the fingerprint of shingles, as 64-bit parts, and those of the fingerprint of words that may differ.
PARTS, WORD_BITS = 4, 7
#: Segments of a word fingerprint, eight of eight bits: one more than may differ.
WORD_SEGMENTS = 8
#: Standard errors that a candidate's distance may be above the one expected at ``SIMILARITY``.
ALLOWED_ERRORS = 3.0
CHUNK_BYTES = 1 << 20
#: Texts and bytes of a block whose shingles are counted in one task; a longer text is a block's only one or nearly so.
TEXT_BLOCK, TEXT_BLOCK_BYTES = 1_024, 4 << 20


def allowed_bits(similarity: float = SIMILARITY, bits: int = 64 * PARTS, errors: float = ALLOWED_ERRORS) -> int:
    """Differing bits of shingle fingerprints up to which texts of a Jaccard similarity are expected.

    Sets of similarity j have the cosine 2j / (1 + j), and each bit differs with the angle's share of a
    half turn; ``errors`` standard errors above the mean are allowed.
    """
    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return int(bits * share + errors * np.sqrt(bits * share * (1 - share)))


def _votes(hashes: np.ndarray, starts: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """64 bits for each group of hashes from ``starts``: set if more than half of the weight has it.

    Bits are counted in lanes of one number, eight of 8 bits or, with weights of at most 1000, four of
    16 bits; runs of so few hashes are added up that no lane can overflow.
    """
    width, run = (8, 255) if weights is None else (16, 64)
    sizes = np.diff(np.append(starts, len(hashes)))
    runs = -(-sizes // run)
    first = np.cumsum(runs) - runs
    cuts = np.repeat(starts, runs) + (np.arange(runs.sum()) - np.repeat(first, runs)) * run
    total = sizes if weights is None else np.add.reduceat(weights, starts)
    lane, out = np.uint64(sum(1 << (width * i) for i in range(64 // width))), np.zeros(len(starts), np.uint64)
    for k in range(width):
        lanes = (hashes >> np.uint64(k)) & lane
        sums = np.add.reduceat(lanes if weights is None else lanes * weights.astype(np.uint64), cuts)
        for i in range(64 // width):
            part = (sums >> np.uint64(width * i)) & np.uint64((1 << width) - 1)
            ones = np.add.reduceat(part.astype(np.int64), first)
            out |= (ones * 2 > total).astype(np.uint64) << np.uint64(width * i + k)
    return out


def text_shingles(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of texts of at least one word, and the text of each; fewer words than ``size`` are one shingle."""
    row, first = np.repeat(np.arange(len(counts)), counts), np.cumsum(counts) - counts
    with np.errstate(over="ignore"):
        shingles = words.copy()
        left = np.repeat(first + counts, counts) - np.arange(len(row))  # words from here to the end of the text
        for k in range(1, size):
            more = np.flatnonzero(left > k)
            shingles[more] = pair(shingles[more], words[more + k], k)
    whole = (left >= size) | (np.arange(len(row)) == first[row])
    return shingles[whole], row[whole]


def text_fingerprints(raw: np.ndarray, offsets: np.ndarray, size: int = ROW_SHINGLE, parts: int = PARTS) -> tuple[np.ndarray, np.ndarray]:
    """For each text a hash of its words in order, and a row: the fingerprint of its words (by the root of their counts), and ``parts`` of its shingles."""
    words, counts = tokens(raw, offsets, NON_SPACE)[:2]
    nodes, out = np.zeros(len(counts), np.uint64), np.zeros((len(counts), 1 + parts), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return nodes, out
    counts = counts[some]
    row, first = np.repeat(np.arange(len(some)), counts), np.cumsum(counts) - counts
    with np.errstate(over="ignore"):
        nodes[some] = mixed(np.add.reduceat(pair(words, (np.arange(len(row)) - first[row]).astype(np.uint64), 0), first))
    order = np.lexsort((words, row))
    fresh = np.ones(len(row), bool)
    fresh[1:] = (words[order][1:] != words[order][:-1]) | (row[order][1:] != row[order][:-1])
    at = np.flatnonzero(fresh)
    times = np.minimum(1000, np.round(8 * np.sqrt(np.diff(np.append(at, len(row)))))).astype(np.int64)
    out[some, 0] = _votes(words[order][at], np.searchsorted(row[order][at], np.arange(len(some))), times)
    shingles, of = text_shingles(words, counts, size)
    starts = np.searchsorted(of, np.arange(len(some)))
    with np.errstate(over="ignore"):
        for i in range(parts):
            out[some, 1 + i] = _votes(mixed(shingles + np.uint64(i) * np.uint64(0x9E3779B97F4A7C15)), starts)
    return nodes, out


def shared_roots(raw: np.ndarray, offsets: np.ndarray, similarity: float, size: int = ROW_SHINGLE) -> np.ndarray:
    """For each text the first one that links of at least ``similarity`` (Jaccard, sets of shingles) reach; texts without words are alone.

    The texts that share a shingle are listed once; a text's lists, counted, give what it shares with every other.
    """
    words, counts = tokens(raw, offsets, NON_SPACE)[:2]
    roots, some = np.arange(len(counts)), np.flatnonzero(counts)
    if len(some) < 2:
        return roots
    shingles, of = text_shingles(words, counts[some], size)
    order = np.lexsort((of, shingles))
    shingles, of = shingles[order], of[order]
    fresh = np.append(True, (shingles[1:] != shingles[:-1]) | (of[1:] != of[:-1]))
    shingles, of = shingles[fresh], of[fresh]
    starts = np.flatnonzero(np.append(True, shingles[1:] != shingles[:-1]))
    lengths = np.diff(np.append(starts, len(of)))
    lists = np.repeat(np.arange(len(starts)), lengths)
    by_text = np.argsort(of, kind="stable")
    sizes = np.bincount(of, minlength=len(some))
    ends = np.cumsum(sizes)
    open_ = np.ones(len(some), bool)
    for seed in range(len(some)):
        frontier = [seed] if open_[seed] else []
        open_[seed] = False
        while frontier and open_.any():
            at = frontier.pop()
            own = lists[by_text[ends[at] - sizes[at] : ends[at]]]
            n = lengths[own]
            places = np.repeat(starts[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            both = np.bincount(of[places], minlength=len(some))
            hit = np.flatnonzero(open_ & (both / (sizes[at] + sizes - both) >= similarity))
            open_[hit] = False
            roots[some[hit]] = some[seed]
            frontier += hit.tolist()
    return roots


def _text_links(rows: np.ndarray, masks: np.ndarray, i: np.ndarray, j: np.ndarray, most: int) -> np.ndarray:
    """Whether rows i and j keep the budgets of their chains (rows of ``masks``) in their words and the bound in their shingles."""
    x, at = rows[i, 0] ^ rows[j, 0], np.arange(len(i))
    for step in range(1, WORD_SEGMENTS):
        at = at[np.bitwise_count(x[at] & (masks[step] if masks.ndim == 1 else masks[at, step])) <= step]
    apart = np.bitwise_count(rows[i[at], 1:] ^ rows[j[at], 1:]).sum(axis=1)
    out = np.zeros(len(x), bool)
    out[at[apart <= most]] = True
    return out


def _group_links(rows: np.ndarray, masks: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links in one large group: all of them while they are few, else a spanning forest."""
    left, right, found, step = [], [], 0, max(1, 500_000 // len(rows))
    for lo in range(0, len(rows), step):
        i, j = np.divmod(np.arange(min(step, len(rows) - lo) * len(rows)), len(rows))
        later = j > i + lo
        i, j = i[later] + lo, j[later]
        hit = _text_links(rows, masks, i, j, most)
        left.append(i[hit])
        right.append(j[hit])
        found += int(hit.sum())
        if found > 4 * len(rows):
            break
    else:
        return np.concatenate(left), np.concatenate(right)
    open_, frontier, left, right = np.arange(1, len(rows)), [0], [], []
    while len(open_):
        if not frontier:
            frontier, open_ = [int(open_[0])], open_[1:]
            continue
        at = frontier.pop()
        hit = _text_links(rows, masks, np.full(len(open_), at), open_, most)
        left += [at] * int(hit.sum())
        right += open_[hit].tolist()
        frontier += open_[hit].tolist()
        open_ = open_[~hit]
    return np.array(left, np.int64), np.array(right, np.int64)


def text_group_links(keys: np.ndarray, nodes: np.ndarray, rows: np.ndarray, ends: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within groups: rows ends[i-1]..ends[i] are group i; keys name the chain's start."""
    starts = np.concatenate([[0], ends[:-1]])
    sizes, left, right = ends - starts, [], []
    for size in np.unique(sizes[(sizes > 1) & (sizes <= SMALL)]):
        a, b = np.triu_indices(size, 1)
        some, step = starts[sizes == size], max(1, 500_000 // len(a))
        for lo in range(0, len(some), step):
            base = some[lo : lo + step, None]
            i, j = (base + a).reshape(-1), (base + b).reshape(-1)
            ok = _text_links(rows, WORD_MASKS[keys[i] >> 17], i, j, most)
            left.append(nodes[i[ok]])
            right.append(nodes[j[ok]])
    for s, e in zip(starts[sizes > SMALL], ends[sizes > SMALL]):
        i, j = _group_links(rows[s:e], WORD_MASKS[keys[s] >> 17], most)
        left.append(nodes[s:e][i])
        right.append(nodes[s:e][j])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _word_masks(first: int) -> np.ndarray:
    """Bits of the first one, two, ... segments of the chain from a segment."""
    mask, out = 0, []
    for l in range(WORD_SEGMENTS):
        mask |= 0xFF << (8 * ((first + l) % WORD_SEGMENTS))
        out.append(mask)
    return np.array(out, np.uint64)


WORD_MASKS = np.array([_word_masks(i) for i in range(WORD_SEGMENTS)], np.uint64)


def text_links(texts: DataFrame, most: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect rows (node, fps) as all links would; see ``near_duplicate_roots``."""

    def bits(at: int, width: int):
        return F.shiftrightunsigned(F.col("fps")[0], at).bitwiseAND(F.lit((1 << width) - 1))

    keys = [F.lit((2 * i + half) << 16) + bits(8 * i, 8) * 16 + bits(8 * ((i + 1) % WORD_SEGMENTS) + 4 * half, 4) for i in range(WORD_SEGMENTS) for half in (0, 1)]
    keyed = texts.select("node", "fps", F.explode(F.array(*keys)).alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / block).alias("blocks"))
    # At most 2 * WORD_SEGMENTS * 2 ** 12 keys.
    rows = keyed.join(F.broadcast(shared), "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    groups = ["key", "block_a", "block_b"]
    rows = rows.select("key", F.least("own", "other").alias("block_a"), F.greatest("own", "other").alias("block_b"), "node", "fps")

    def found(table):
        import pyarrow as pa

        group = np.stack([np.asarray(table[c]) for c in groups], axis=1)
        ends = np.append(np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1, len(group)).astype(np.int64)
        fps = np.asarray(table["fps"].combine_chunks().flatten()).view(np.uint64).reshape(len(group), -1)
        a, b = text_group_links(group[:, 0], np.asarray(table["node"]), fps, ends, most)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def search(batches):
        """Sorted rows of whole groups; a group may span batches."""
        import pyarrow as pa

        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            if not table.num_rows:
                continue
            last = np.ones(table.num_rows, bool)
            for c in groups:
                values = np.asarray(table[c])
                last &= values == values[-1]
            first = int(np.argmax(last))
            held = table.slice(first).combine_chunks()
            if first:
                yield found(table.slice(0, first))
        if held is not None:
            yield found(held)

    n = max(1, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(n, *groups).sortWithinPartitions(*groups, "node").mapInArrow(search, "a long, b long")


def counted_links(docs: DataFrame, texts: DataFrame, groups: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between texts of one group (node, root) that share ``similarity`` of their shingles, as all such links would connect them.

    Groups are cut into blocks of bounded rows and bytes; every two blocks of a group meet in one task.
    """
    import pyarrow as pa

    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    asked = groups.join(texts.select("node", "first.id_key", "first.text_key"), "node")
    found = docs.select(*row_keys(), text).join(asked, ["id_key", "text_key"]).select("node", "root", "text")
    members = pinned(found.dropDuplicates(["node"]), "simhash-members")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / TEXT_BLOCK), F.ceil(F.sum(F.octet_length("text")) / TEXT_BLOCK_BYTES))
    rows = members.join(members.groupBy("root").agg(blocks.alias("blocks")), "root")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("root", F.least("own", "other").alias("block_a"), F.greatest("own", "other").alias("block_b"), "node", "text")

    def run(table: pa.Table) -> pa.Table:
        raw, offsets = column_bytes(table["text"].combine_chunks())
        nodes = np.asarray(table["node"])
        roots = shared_roots(raw, offsets, similarity)
        at = np.flatnonzero(roots != np.arange(len(roots)))
        return pa.table({"a": pa.array(nodes[at], pa.int64()), "b": pa.array(nodes[roots[at]], pa.int64())})

    return rows.groupBy("root", "block_a", "block_b").applyInArrow(run, "a long, b long")


def near_duplicate_rows(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """id_key, text_key of the one row of each class that stays: the least id (null last), then the least hash of the text.

    Two texts link if their sets of five-word shingles are alike to ``similarity`` or more, as counted in
    the texts. Candidates are found by pigeonring over a fingerprint of their words, of which ``WORD_BITS``
    may differ (a ring of eight segments has a chain whose first l segments differ in fewer than l bits),
    and by fingerprints of 256 bits of their shingles. What candidates connect is a group; its texts are
    counted against each other. Texts of equal words are one before the search; texts without words are one.
    """
    most = allowed_bits(similarity)
    rows = docs.select(*row_keys(), F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("_raw"))

    def run(batch):
        raw, offsets = column_bytes(batch.column("_raw"))
        found = [text_fingerprints(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in chunks(offsets, CHUNK_BYTES)]
        return [np.concatenate([x for x, _ in found]).view(np.int64), list(np.concatenate([x for _, x in found]).view(np.int64))] if found else [[], []]

    own = pinned(map_columns(rows, ["no_id", "id_key", "text_key"], "node long, fps array<long>", run), "simhash-docs")
    texts = pinned(own.groupBy("node").agg(F.min(F.struct("no_id", "id_key", "text_key")).alias("first"), F.any_value("fps").alias("fps")), "simhash-texts")
    groups = connected_components(text_links(texts, most))
    roots = connected_components(counted_links(docs, texts, groups, similarity))
    rooted = texts.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    return rooted.select("first.id_key", "first.text_key")


def row_keys() -> list:
    """Two columns without nulls that tell rows apart by id and text."""
    text = F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.col("doc_id").isNull())
    return [F.coalesce(F.col("doc_id"), F.lit(0)).cast("long").alias("id_key"), text.alias("text_key")]


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Exactly one row of each class of near duplicates; whole rows travel as one column, so no name can clash."""
    boxed = docs.select(F.struct(*docs.columns).alias("row"), *row_keys())
    kept = boxed.join(near_duplicate_rows(docs, similarity), ["id_key", "text_key"], "left_semi")
    return kept.dropDuplicates(["id_key", "text_key"]).select("row.*")
