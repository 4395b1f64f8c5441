"""Mixing sources to target weights by Sainte-Lague apportionment.

Source targets are cut into equal-token blocks. Blocks go first to sources, then to the shards of
each source, always to the highest quotient votes / (2 * seats + 1). Every shard puts its documents
in a seeded order, which makes one token stream per epoch, and takes the first blocks of that stream:
all documents once before any document twice.

Results for odd input: null text has size 0 and is taken 0 times; sources are ordered by code point
with null last, an empty string is a source of its own; repeated rows are documents of their own;
an empty table gives an empty result; extra columns are ignored.

Scale: one narrow table (id, source, size) is shuffled once by (source, shard); shards hold about
``shard_tokens`` tokens, so a hot source is many shards. Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, pinned, table

#: A table of at most so many sources is broadcast; a larger one is joined by shuffle.
BROADCAST_SOURCES = 10_000
#: Shards of a source at most: their quotas are ranked in one task, while each still sorts only ids and sizes.
MAX_SHARDS = 20_000


def source_targets(sizes: DataFrame, weights=(3.0, 1.0, 2.0), epochs: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size, target: weights share ``epochs`` times all sizes; no target above ``cap`` sizes.

    The excess of capped sources is shared again by weight until none is above its cap. In the order
    of cap / weight the capped sources come first, so the level follows from running sums.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = by_source.select("source", "source_size", weight.alias("weight")).withColumn("ratio", F.col("source_size") * cap / F.col("weight"))
    everything = Window.partitionBy()
    fill = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) * epochs - F.coalesce(F.sum(F.col("source_size") * cap).over(fill), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(fill), F.lit(0.0)))
    levels = ranked.withColumn("level", level)
    common = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything)
    target = F.least(F.col("source_size") * cap, F.coalesce(common * F.col("weight"), F.col("source_size") * cap))
    return levels.select("source", "source_size", target.alias("target"))


def sainte_lague(votes: DataFrame, keys: list[str], group: list[str], seats: str) -> DataFrame:
    """Give ``seats`` (a column, equal within a group) to the rows of each group by their ``votes``.

    The divisor form bounds each row's seats: votes / D rounded, where D is off by at most half a seat
    a row. Seats below the bound are given at once; only the few between both bounds are ranked by quotient.
    """
    of = Window.partitionBy(*group)
    share = F.col("votes") * F.col(seats) / F.sum("votes").over(of)
    slack = F.count(F.lit(1)).over(of) / (2.0 * F.greatest(F.col(seats), F.lit(1)))
    bounds = (
        votes.withColumn("share", F.coalesce(F.when(F.col("votes") > 0, share), F.lit(0.0)))
        .withColumn("slack", slack)
        .withColumn("least", F.greatest(F.lit(0), F.floor(F.col("share") * (1 - F.col("slack")) - 0.5)).cast("long"))
        .withColumn("most", F.when(F.col("votes") > 0, F.ceil(F.col("share") * (1 + F.col("slack")) + 0.5)).otherwise(0).cast("long"))
    )
    open_seats = bounds.withColumn("open", F.col(seats) - F.sum("least").over(of)).select(
        *keys, *[g for g in group if g not in keys], "least", "open", "votes", F.explode_outer(F.when(F.col("most") > F.col("least"), F.sequence("least", F.col("most") - 1))).alias("seat")
    )
    quotient = F.col("votes") / (2 * F.col("seat") + 1)
    rank = F.row_number().over(of.orderBy(quotient.desc_nulls_last(), *[F.col(k).asc_nulls_last() for k in keys], "seat"))
    won = F.when(F.col("seat").isNotNull() & (rank <= F.col("open")), 1).otherwise(0)
    return open_seats.withColumn("won", won).groupBy(*keys).agg((F.first("least") + F.sum("won")).cast("long").alias("quota"))


def _same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def mix(docs: DataFrame, weights=(3.0, 1.0, 2.0), epochs: float = 1.5, cap: float = 2.0, block_tokens: int = 16, shard_tokens: int = 65_536, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, taken for each row of ``docs``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    sizes = pinned(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("text_key")), "mix-sizes")
    targets = source_targets(sizes, weights, epochs, cap)
    seats = targets.withColumn("all_seats", F.round(F.sum("target").over(Window.partitionBy()) / block_tokens).cast("long")).withColumn("votes", F.col("target"))
    quotas = sainte_lague(seats.withColumn("everything", F.lit(1)), ["source"], ["everything"], "all_seats")
    plan = targets.alias("t").join(quotas.alias("q"), _same(F.col("t.source"), F.col("q.source"))).select("t.source", "source_size", "target", "quota", F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.greatest(F.lit(float(shard_tokens)), F.col("source_size") / MAX_SHARDS))).cast("long").alias("shards"))
    plan = pinned(plan, "mix-plan")
    small = plan.count() <= BROADCAST_SOURCES
    hint = F.broadcast if small else (lambda x: x)
    seeded = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text_key"))
    dealt = sizes.alias("d").join(hint(plan).alias("p"), _same(F.col("d.source"), F.col("p.source"))).select("doc_id", F.col("d.source").alias("source"), "size", "source_size", "target", "quota", seeded.alias("seeded"), F.pmod(F.xxhash64(F.lit(seed + 1), F.col("doc_id"), F.col("text_key")), F.col("shards")).alias("shard"))
    shards = dealt.groupBy("source", "shard").agg(F.sum("size").alias("votes"), F.first("quota").alias("source_quota"))
    shard_quotas = sainte_lague(shards, ["source", "shard"], ["source"], "source_quota").withColumnRenamed("quota", "shard_quota")
    by_shard = Window.partitionBy("source", "shard")
    stream = by_shard.orderBy("seeded", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumn("start", F.sum("size").over(stream) - F.col("size")).withColumn("shard_size", F.sum("size").over(by_shard)).alias("d")
    placed = placed.join(shard_quotas.alias("s"), _same(F.col("d.source"), F.col("s.source")) & (F.col("d.shard") == F.col("s.shard"))).withColumn("room", F.col("shard_quota") * block_tokens)
    zero = F.lit(0).cast("long")
    taken = sum((F.greatest(zero, F.least(F.col("size"), F.col("room") - F.col("start") - F.col("shard_size") * k)) for k in range(1, int(cap))), F.greatest(zero, F.least(F.col("size"), F.col("room") - F.col("start"))))
    return placed.select("doc_id", F.col("d.source").alias("source"), "size", "source_size", "target", taken.alias("taken"))


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, **kwargs) -> DataFrame:
    """The mix as rows of ``docs``: each document as often as it is taken, the last block's document rounded.

    Rows are told apart by a hash of id, text and source, so only rows that are equal in all three share a count.
    """
    key = F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.coalesce("text", F.lit("")), F.col("source").isNull(), "source").alias("doc_id")
    counts = mix(docs.select(key, "text", "source"), **kwargs).select("doc_id", "size", "taken")
    copies = counts.groupBy("doc_id").agg(F.sum("taken").alias("_taken"), F.sum("size").alias("_size"))
    times = F.when(F.col("_size") > 0, F.floor(F.col("_taken") / F.col("_size") + 0.5)).otherwise(0).cast("int")
    kept = copies.select("doc_id", times.alias("times")).where("times > 0")
    boxed = docs.select(key, F.struct(*docs.columns).alias("row"))
    joined = boxed.join(kept, "doc_id").select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"))
    return joined.select("row.*")
