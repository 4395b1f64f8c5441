"""A sieve before a join: rows of a large table whose key is surely not among many keys are told without being moved.

The keys set bits of a map by their hash. The map has a bounded size whatever the number of keys, so it goes to
every task; a row whose bit is not set has no such key. The others may have it, and are few: a plain join decides.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits for each key, and the most bits of a map: 2^28 bits are half a million rows of eight words, some 50 MB in memory.
BITS_A_KEY, MOST_BITS = 32, 1 << 28
WORDS = 8  # 512 bits in a row


def _place(size: int, *key: Column) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(size).cast("long"))


@dataclass(frozen=True)
class Sieve:
    """words (_row, _words): the map's bits, WORDS words of 64 in a row; rows without any are left out."""

    words: DataFrame
    size: int

    def marked(self, rows: DataFrame, name: str, *key: str) -> DataFrame:
        """``rows`` with a column ``name``: false if ``key`` is surely not among the keys."""
        at = rows.withColumn("_place", _place(self.size, *[F.col(c) for c in key]))
        row = F.shiftright("_place", 9)
        word = F.col("_words")[F.pmod(F.shiftright("_place", 6), F.lit(WORDS)).cast("int")]
        found = at.withColumn("_row", row).join(F.broadcast(self.words), "_row", "left")  # bounded, see MOST_BITS
        return found.select(*rows.columns, (F.coalesce(F.getbit(word, F.pmod("_place", F.lit(64)).cast("int")), F.lit(0)) == 1).alias(name))


def sieve(keys: DataFrame, *key: str) -> Sieve:
    """The sieve of the values of ``key`` in ``keys``, which are counted: a table, not a plan that is costly to run."""
    size = min(MOST_BITS, 1 << max(12, (BITS_A_KEY * keys.count() - 1).bit_length()))
    places = keys.select(_place(size, *[F.col(c) for c in key]).alias("p"))
    bit = F.expr("shiftleft(1L, CAST(p % 64 AS INT))")
    word = F.pmod(F.shiftright("p", 6), F.lit(WORDS))
    masks = [F.bit_or(F.when(word == i, bit).otherwise(F.lit(0).cast("long"))) for i in range(WORDS)]
    grouped = places.groupBy(F.shiftright("p", 9).alias("_row")).agg(*[m.alias(f"m{i}") for i, m in enumerate(masks)])
    return Sieve(grouped.select("_row", F.array(*[f"m{i}" for i in range(WORDS)]).alias("_words")), size)
