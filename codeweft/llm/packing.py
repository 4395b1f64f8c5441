"""Best-fit packing by linear grouping.

Texts become token ids and an end id; documents over the capacity are cut so that only the first
piece is shorter. Lengths are at most the capacity, so the histogram of lengths is small however
large the corpus: it alone goes to the driver. There, large lengths are sorted into groups of equal
cardinality and rounded up to the group's largest, few-size configurations are filled as full as
their sizes allow and repeated, the groups' actual lengths are substituted, and the small lengths
go where they leave the least room. The plan is a table of runs: ranks a..b of a length go to
sequences c..d at an offset. Documents get their rank within their length by two-level counting and
look up their run.

Results for odd input: null text is empty and packs its end id alone; repeated rows are packed
each; texts of any length are cut; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_columns, pinned, table

CAPACITY = 1024
END_ID = 2
SPECIAL = "<|endoftext|>"


@lru_cache(maxsize=2)
def encoder(path: str | None = None):
    """The byte-level BPE as an encoder; its ids equal those of the vocabulary's JSON form (tested)."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})


def token_ids(text: str, path: str | None = None) -> np.ndarray:
    return np.append(encoder(path).encode_to_numpy(text, allowed_special="all"), END_ID).astype("<u4")


def pieces(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32."""

    def run(batch):
        sizes, sums = [], []
        for raw in batch.column("_raw").to_pylist():
            ids = token_ids(raw.decode("utf-8", "replace"), path)
            cuts = [0, *range(len(ids) % capacity or capacity, len(ids), capacity), len(ids)]
            sizes.append(len(ids))
            sums.append([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:])])
        return [sizes, sums]

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_raw"))
    cut = map_columns(rows, ["doc_id"], "n long, sums array<long>", run)
    first = F.pmod(F.col("n") - 1, F.lit(capacity)) + 1
    each = cut.select("doc_id", "n", first.alias("first"), F.posexplode("sums").alias("piece", "ids_crc32"))
    start = F.when(F.col("piece") == 0, F.lit(0)).otherwise(F.col("first") + (F.col("piece") - 1) * capacity)
    length = F.when(F.col("piece") == 0, F.col("first")).otherwise(F.lit(capacity))
    return each.select("doc_id", "piece", start.cast("long").alias("start"), length.cast("long").alias("length"), "ids_crc32")


def _fullest(sizes: list[int], left: list[int], room: int) -> list[int]:
    """How many of each size fill ``room`` best, within what is left: reachable sums, then back."""
    reach = np.zeros(room + 1, bool)
    reach[0] = True
    stages = []
    for size, n in zip(sizes, left):
        stages.append(reach)
        reach = reach.copy()
        for _ in range(min(n, room // size)):
            grown = reach.copy()
            grown[size:] |= reach[:-size]
            if (grown == reach).all():
                break
            reach = grown
    at, take = int(np.flatnonzero(reach)[-1]), [0] * len(sizes)
    for i in range(len(sizes) - 1, -1, -1):
        while not stages[i][at]:
            at -= sizes[i]
            take[i] += 1
    return take


class _Plan:
    """Runs (length, first rank, count, first sequence, offset), and the ranges of sequences by room left."""

    def __init__(self, capacity: int):
        self.capacity, self.runs, self.ranks, self.bins = capacity, [], {}, 0
        self.rooms, self.ranges = [], {}

    def put(self, length: int, count: int, bin_: int, offset: int) -> None:
        rank = self.ranks.get(length, 0)
        self.runs.append((length, rank, count, bin_, offset))
        self.ranks[length] = rank + count

    def leave(self, room: int, bin_: int, count: int) -> None:
        if room and count:
            if room not in self.ranges:
                self.ranges[room] = []
                insort(self.rooms, room)
            self.ranges[room].append((bin_, count))

    def best_fit(self, length: int, count: int) -> None:
        while count:
            at = bisect_left(self.rooms, length)
            if at == len(self.rooms):
                new = -(-count // (self.capacity // length))
                self.leave(self.capacity, self.bins, new)
                self.bins += new
                continue
            room = self.rooms[at]
            bin_, n = self.ranges[room].pop()
            used = min(n, count)
            if used < n:
                self.ranges[room].append((bin_ + used, n - used))
            if not self.ranges[room]:
                del self.ranges[room]
                self.rooms.pop(at)
            self.put(length, used, bin_, self.capacity - room)
            self.leave(room - length, bin_, used)
            count -= used


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = 160, small: int = 8) -> list[tuple[int, int, int, int, int]]:
    """Runs that place ``histogram`` (length: count); lengths over capacity / ``small`` are large."""
    out = _Plan(capacity)
    large = [(n, histogram[n]) for n in sorted(histogram, reverse=True) if n > capacity // small and histogram[n]]
    each = max(1, -(-sum(c for _, c in large) // groups))
    members: list[list[list[int]]] = []
    room = 0
    for length, count in large:
        while count:
            if not room:
                members.append([])
                room = each
            used = min(room, count)
            members[-1].append([length, used])
            room, count = room - used, count - used
    sizes = [m[0][0] for m in members]
    left = [sum(c for _, c in m) for m in members]
    while any(left):
        top = next(i for i, n in enumerate(left) if n)
        rest = [n - (i == top) for i, n in enumerate(left)]
        some = [i for i, n in enumerate(rest) if n and sizes[i] <= capacity - sizes[top]]
        take = _fullest([sizes[i] for i in some], [rest[i] for i in some], capacity - sizes[top]) if some else []
        slots = [top, *(i for i, n in zip(some, take) for _ in range(n))]
        need = {i: slots.count(i) for i in slots}
        times = min(left[i] // n for i, n in need.items())
        drawn = []
        for i in slots:
            need_now, segments = times, []
            while need_now:
                length, count = members[i][0]
                used = min(count, need_now)
                segments.append((length, used))
                need_now -= used
                if used == count:
                    members[i].pop(0)
                else:
                    members[i][0][1] -= used
            left[i] -= times
            drawn.append(segments)
        done = 0
        while done < times:
            step = min(s[0][1] for s in drawn)
            offset = 0
            for s in drawn:
                length, count = s[0]
                out.put(length, step, out.bins + done, offset)
                offset += length
                s[:] = s[1:] if count == step else [(length, count - step), *s[1:]]
            out.leave(capacity - offset, out.bins + done, step)
            done += step
        out.bins += times
    for length in sorted((n for n in histogram if n <= capacity // small), reverse=True):
        out.best_fit(length, histogram[length])
    return out.runs


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, **columns) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    cut = pinned(pieces(docs, capacity, path=path, **columns), "pack-pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = spark.createDataFrame(plan(histogram, capacity), "length long, first_rank long, count long, first_sequence long, offset long")
    buckets = min(65_536, max(16, sum(histogram.values()) // 2_000))
    bucketed = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = bucketed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ranked_before"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = bucketed.withColumn("inside", F.row_number().over(inside) - 1).join(starts, ["length", "bucket"]).withColumn("rank", F.col("ranked_before") + F.col("inside"))
    # The runs come from a histogram of at most ``capacity`` lengths, so their number doesn't grow with the rows.
    found = ranked.join(F.broadcast(runs), (ranked["length"] == runs["length"]) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("count")))
    return found.select("doc_id", "piece", "start", ranked["length"], "ids_crc32", (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"), "offset")


def op10_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
