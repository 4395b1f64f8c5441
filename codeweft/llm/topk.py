"""Exact top-k search by inner product with a dual-tree over cover trees.

The best inner products of a query are its nearest rows once every row has one more component that gives
all rows the same norm (and queries a zero there), so Euclidean cover trees serve. Vectors are dealt to
the nearest of some pivots, and a pivot's rows are split by a hash, so blocks have a bounded size, hot
places too. A place knows its covering radius. First the queries meet the blocks of their own place,
which gives each a first kth score; then each goes only to those other places whose covering radius can
hold a better one. In a task, a cover tree over the block's distinct vectors and one over its queries are
walked together: a pair of nodes is left out if its centres' distance less both covering radii cannot
reach the query group's worst kth score.

Quantised components make scores exact integers. Ties go to the smaller id.

Results for odd input: vectors that are null or hold null or non-finite components, and rows with a
null id, take no part; rows that repeat an id are rows of their own, each a candidate of the others and,
where the id asks, a query; vectors are compared with those of their own length; a query with fewer than
k candidates gets them all; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import pinned, table

#: Rows of a data block and of a query chunk at most, about.
DATA_BLOCK, LEAST_BLOCK, QUERY_CHUNK = 8_192, 2_048, 8_192
#: Pivots: the root of the number of rows over ``ROWS_A_PIVOT``, within these bounds.
LEAST_PIVOTS, MOST_PIVOTS, ROWS_A_PIVOT = 16, 1_024, 64
#: Points of a leaf of the data and of the query tree; centres of a net that are chosen at once.
LEAF, QUERY_LEAF, NET = 16, 32, 64


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (a * a).sum(axis=1)[:, None] - 2 * a @ b.T + (b * b).sum(axis=1)))


class CoverTree:
    """Nodes over the rows of ``points``, each a slice of ``order`` and a centre that covers it within a radius.

    The children of a node have centres more than half its radius apart and cover within that half.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.order = points, np.arange(len(points))
        self.centre, self.radius, self.lo, self.hi, self.first, self.last = [], [], [], [], [], []
        if len(points):
            self._node(0, _distances(points, points[:1]).max(), 0, len(points))
            todo = [0]
            while todo:
                todo += self._split(todo.pop(), leaf)
        for name in ("centre", "radius", "lo", "hi", "first", "last"):
            setattr(self, name, np.array(getattr(self, name)))

    def _node(self, centre: int, radius: float, lo: int, hi: int) -> int:
        for name, value in (("centre", centre), ("radius", float(radius)), ("lo", lo), ("hi", hi), ("first", 0), ("last", 0)):
            getattr(self, name).append(value)
        return len(self.lo) - 1

    def _net(self, rows: np.ndarray, half: float) -> list[tuple[int, float, np.ndarray]]:
        """(centre, radius, rows) of a greedy net: centres over ``half`` apart, all rows within it of one."""
        nets, rest = [], rows
        while len(rest):
            some = rest[:NET]
            near = _distances(self.points[some], self.points[some]) <= half
            chosen: list[int] = []
            for i in range(len(some)):
                if not near[i, chosen].any():
                    chosen.append(i)
            d = _distances(self.points[rest], self.points[some[chosen]])
            best = d.argmin(axis=1)
            far = d[np.arange(len(rest)), best]
            for j, c in enumerate(chosen):
                own = (best == j) & (far <= half)
                nets.append((int(some[c]), float(far[own].max()), rest[own]))
            rest = rest[far > half]
        return nets

    def _split(self, node: int, leaf: int) -> list[int]:
        lo, hi, radius = self.lo[node], self.hi[node], self.radius[node]
        if hi - lo <= leaf or radius == 0:
            return []
        nets = self._net(self.order[lo:hi], radius / 2)
        at, made = lo, []
        for centre, r, rows in nets:
            self.order[at : at + len(rows)] = rows
            made.append(self._node(centre, r, at, at + len(rows)))
            at += len(rows)
        self.first[node], self.last[node] = made[0], made[-1] + 1
        return made

    def depth(self) -> int:
        """Levels of nodes."""
        level = np.ones(len(self.lo), np.int64)
        for i in range(len(self.lo)):
            level[self.first[i] : self.last[i]] = level[i] + 1
        return int(level.max(initial=0))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best columns of each row, by score, ties to the smaller id."""
    if scores.shape[1] > 4 * k:
        kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        keep = (scores >= kth).any(axis=0)
        scores, ids = scores[:, keep], ids[:, keep]
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


NONE = -np.inf


def search_block(q_rows, queries, floor, r_rows, r_ids, data, k: int, norm: float, seen: dict | None = None):
    """Scores and places (in ``r_rows``; -1 where none) of the k best of ``data`` for each query that reach its ``floor``.

    ``norm``: no row of the table has a larger squared norm. ``seen`` gets the pairs of points and those that were scored.
    """
    # Copies of a vector: only the k + 1 smallest ids can be among the best k of a query (one may be its own).
    by_id = np.lexsort((r_rows, r_ids))
    distinct, group = np.unique(data[by_id], axis=0, return_inverse=True)
    member = np.argsort(group, kind="stable")
    first = np.searchsorted(group[member], np.arange(len(distinct) + 1))
    rank = np.arange(len(member)) - first[group[member]]
    kept = member[rank <= k]
    starts = np.searchsorted(group[kept], np.arange(len(distinct) + 1))  # members of point p: kept[starts[p]:starts[p + 1]], places by id
    points, q_points = distinct.astype(np.float64), queries.astype(np.float64)
    squares = (points * points).sum(axis=1)
    r_tree = CoverTree(np.concatenate([points, np.sqrt(np.maximum(0, norm - squares))[:, None]], axis=1))
    q_tree = CoverTree(np.concatenate([q_points, np.zeros((len(q_points), 1))], axis=1), QUERY_LEAF)
    q_squares = (q_points * q_points).sum(axis=1)
    top = np.full((len(queries), k), NONE), np.full((len(queries), k), np.iinfo(np.int64).max)
    worst, scored = np.array(floor, np.float64), 0
    own_rows = r_rows[by_id]

    def bounds(a: int, nodes: np.ndarray) -> np.ndarray:
        """The best score that any pair of points of the nodes can have."""
        d = _distances(q_tree.points[q_tree.centre[a]][None], r_tree.points[r_tree.centre[nodes]])[0]
        least = np.maximum(0, d - q_tree.radius[a] - r_tree.radius[nodes] - 1e-6 * (1 + d))
        return (q_squares[q_tree.order[q_tree.lo[a] : q_tree.hi[a]]].max() + norm - least * least) / 2 + 1

    def base(rows: np.ndarray, cols: np.ndarray) -> None:
        nonlocal scored
        scored += len(rows) * len(cols)
        scores = q_points[rows] @ points[cols].T
        hit = (scores >= worst[rows, None]).any(axis=0)
        cols, scores = cols[hit], scores[:, hit]
        if not len(cols):
            return
        n = starts[cols + 1] - starts[cols]
        owner = np.repeat(np.arange(len(cols)), n)
        at = kept[np.repeat(starts[cols] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        scores = np.where(own_rows[at][None, :] == q_rows[rows, None], NONE, scores[:, owner])
        top[0][rows], top[1][rows] = _best(np.concatenate([top[0][rows], scores], axis=1), np.concatenate([top[1][rows], np.broadcast_to(at, scores.shape)], axis=1), k)
        worst[rows] = np.maximum(worst[rows], top[0][rows][:, -1])

    todo = [(0, np.array([0]))] if len(points) and len(queries) else []
    while todo:
        a, nodes = todo.pop()
        rows = q_tree.order[q_tree.lo[a] : q_tree.hi[a]]
        leaf = q_tree.first[a] == q_tree.last[a]
        while True:
            reach = bounds(a, nodes)
            nodes, reach = nodes[reach >= worst[rows].min()], reach[reach >= worst[rows].min()]
            inner = (r_tree.first[nodes] < r_tree.last[nodes]) & (leaf | (r_tree.radius[nodes] >= q_tree.radius[a]))
            if not inner.any():
                break
            first_child, n = r_tree.first[nodes[inner]], r_tree.last[nodes[inner]] - r_tree.first[nodes[inner]]
            children = np.repeat(first_child - np.cumsum(n) + n, n) + np.arange(n.sum())
            nodes = np.concatenate([nodes[~inner], children])
        if not leaf:
            todo += [(c, nodes) for c in range(q_tree.first[a], q_tree.last[a])]
            continue
        order, at, step = np.argsort(-reach, kind="stable"), 0, 64
        nodes, reach = nodes[order], reach[order]
        while at < len(nodes) and reach[at] >= worst[rows].min():  # the most promising first
            some = nodes[at : at + step]
            some = some[reach[at : at + step] >= worst[rows].min()]
            n = r_tree.hi[some] - r_tree.lo[some]
            base(rows, r_tree.order[np.repeat(r_tree.lo[some] - np.cumsum(n) + n, n) + np.arange(n.sum())])
            at, step = at + step, min(4_096, 4 * step)
    if seen is not None:
        seen.update(pairs=len(queries) * len(points), scored=scored, data_levels=r_tree.depth(), query_levels=q_tree.depth())
    found = np.where(np.isneginf(top[0]), -1, top[1])
    return top[0], np.where(found >= 0, by_id[np.maximum(found, 0)], -1)


def quantised(embeddings: DataFrame, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and v: floor(scale * x) of each component x."""
    v = F.col(vector_col)
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return embeddings.where(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))


def _matrix(column) -> np.ndarray:
    """Rows of an Arrow column of lists of one length."""
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return np.asarray(column.flatten(), np.int64).reshape(len(column), -1)


FOUND = "row long, query_id long, found long, vec_id long, score long"


def nearest(rows: DataFrame, is_query, k: int = 5, data_block: int = DATA_BLOCK, query_chunk: int = QUERY_CHUNK, pivots: int | None = None) -> DataFrame:
    """row, query_id, found, vec_id, score: among them the k best rows for each row of ``rows`` (vec_id, v) where ``is_query``."""
    rows = pinned(rows.withColumns({"row": F.monotonically_increasing_id(), "is_query": F.coalesce(is_query, F.lit(False))}), "topk-rows")
    square = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x * x)
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("norm")).first()
    n, norm = int(stats["n"]), float(stats["norm"] or 0)
    spark, pivots = rows.sparkSession, pivots or min(MOST_PIVOTS, max(LEAST_PIVOTS, int(n**0.5) // 8))
    size = max(LEAST_BLOCK, min(data_block, n // 64)) if data_block == DATA_BLOCK else data_block
    # At most MOST_PIVOTS rows, by hash.
    chosen = [(len(r["v"]), np.array(r["v"], np.float64)) for r in rows.orderBy(F.xxhash64("row"), "row").limit(pivots).select("v").collect()]

    def lifted(x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(0, norm - (x * x).sum(axis=1)))[:, None]], axis=1)

    def centres(width: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and vectors of the pivots of a length; of a length without any, the origin."""
        own = np.array([i for i, (w, _) in enumerate(chosen) if w == width], np.int64)
        return (own, np.stack([chosen[i][1] for i in own])) if len(own) else (np.array([pivots]), np.zeros((1, width)))

    dealt_schema = StructType.fromDDL("row long, vec_id long, v array<long>, is_query boolean, place long, far double")

    def deal(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(dealt_schema)
        for batch in batches:
            widths = np.asarray(batch.column("v").value_lengths())
            place, far = np.zeros(len(widths), np.int64), np.zeros(len(widths))
            for width in np.unique(widths):
                at = np.flatnonzero(widths == width)
                own, c = centres(int(width))
                d = _distances(lifted(_matrix(batch.column("v").take(pa.array(at))).astype(np.float64)), lifted(c))
                near = d.argmin(axis=1)
                place[at], far[at] = int(width) * (pivots + 1) + own[near], d[np.arange(len(at)), near]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name).cast(f.type) for f in list(arrow)[:4]), pa.array(place), pa.array(far)], schema=arrow)

    dealt = pinned(rows.select("row", "vec_id", "v", "is_query").mapInArrow(deal, dealt_schema), "topk-dealt")
    # One row for each place: at most ``pivots`` + 1 for each vector length.
    places = dealt.groupBy("place").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("is_query"), 1)).alias("queries"), F.max("far").alias("radius")).orderBy("place").collect()
    radius, chunk_of, asked = {r["place"]: r["radius"] for r in places}, {}, 0
    for r in places:  # small places share a chunk, a hot one has several
        chunk_of[r["place"]] = (asked // query_chunk, max(1, -(-r["queries"] // query_chunk)))
        asked += r["queries"]
    ways = F.broadcast(spark.createDataFrame([(r["place"], max(1, -(-r["n"] // size)), *chunk_of[r["place"]]) for r in places], "place long, splits long, chunk long, chunks long"))
    placed = dealt.join(ways, "place")
    data = placed.select("place", F.pmod(F.xxhash64("row"), F.col("splits")).alias("split"), "row", "vec_id", "v")
    queries = placed.where("is_query").select("place", (F.col("chunk") + F.pmod(F.xxhash64("row", F.lit(1)), F.col("chunks"))).alias("chunk"), "row", "vec_id", "v")

    def meet(sent: DataFrame) -> DataFrame:
        """``sent``: queries (chunk, row, vec_id, v, floor) with the data place ``to``; a chunk and a block meet in one task."""
        spread = sent.join(ways.select(F.col("place").alias("to"), F.col("splits").alias("to_splits")), "to")
        left = spread.withColumn("to_split", F.explode(F.sequence(F.lit(0).cast("long"), F.col("to_splits") - 1))).select("to", "to_split", "chunk", "row", "vec_id", "v", "floor")
        wanted = sent.select(F.col("to").alias("place"), "chunk").distinct()
        right = data.join(wanted, "place").select(*[F.col(c).alias(f"d_{c}") for c in ("place", "split", "chunk", "row", "vec_id", "v")])

        def run(a, b):
            import pyarrow as pa

            names = ["row", "query_id", "found", "vec_id", "score"]
            if not a.num_rows or not b.num_rows:
                return pa.table({c: pa.array([], pa.int64()) for c in names})
            q_rows, rows_, ids = np.asarray(a["row"]), np.asarray(b["d_row"]), np.asarray(b["d_vec_id"])
            floor = np.array([NONE if x is None else x for x in a["floor"].to_pylist()], np.float64)
            scores, at = search_block(q_rows, _matrix(a["v"]), floor, rows_, ids, _matrix(b["d_v"]), k, norm)
            some = at >= 0
            q = np.broadcast_to(np.arange(len(q_rows))[:, None], at.shape)[some]
            return pa.table(dict(zip(names, (q_rows[q], np.asarray(a["vec_id"])[q], rows_[at[some]], ids[at[some]], scores[some].astype(np.int64)))))

        return left.groupBy("to", "to_split", "chunk").cogroup(right.groupBy("d_place", "d_split", "d_chunk")).applyInArrow(run, FOUND)

    first = pinned(meet(queries.select(F.col("place").alias("to"), "chunk", "row", "vec_id", "v", F.lit(None).cast("long").alias("floor"))), "topk-first")
    ranked = first.groupBy("row").agg(F.slice(F.sort_array(F.collect_list("score"), False), 1, k).alias("best"))
    floors = ranked.select("row", F.when(F.size("best") >= k, F.element_at("best", k)).alias("floor"))
    with_floor = queries.join(floors, "row", "left").select("place", "chunk", "row", "vec_id", "v", "floor")
    routed_schema = StructType.fromDDL("chunk long, row long, vec_id long, v array<long>, floor long, places array<long>")

    def route(batches):
        """The other places that can hold a row as good as a query's kth so far."""
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(routed_schema)
        for batch in batches:
            widths, home = np.asarray(batch.column("v").value_lengths()), np.asarray(batch.column("place"))
            floor = np.array([NONE if x is None else x for x in batch.column("floor").to_pylist()], np.float64)
            out: list = [[] for _ in range(len(widths))]
            for width in np.unique(widths):
                at = np.flatnonzero(widths == width)
                q = _matrix(batch.column("v").take(pa.array(at))).astype(np.float64)
                own, c = centres(int(width))
                names = int(width) * (pivots + 1) + own
                far = np.array([radius.get(int(p), -1.0) for p in names])
                d = _distances(np.concatenate([q, np.zeros((len(q), 1))], axis=1), lifted(c))
                least = np.maximum(0, d - far - 1e-6 * (1 + d))
                reach = ((q * q).sum(axis=1)[:, None] + norm - least * least) / 2 + 1
                ok = (reach >= floor[at, None]) & (far >= 0) & (names[None, :] != home[at, None])
                for i, mine in zip(at, ok):
                    out[i] = names[mine].tolist()
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name).cast(f.type) for f in list(arrow)[:5]), pa.array(out, arrow.field("places").type)], schema=arrow)

    sent = pinned(with_floor.mapInArrow(route, routed_schema), "topk-routed").withColumn("to", F.explode("places")).select("to", "chunk", "row", "vec_id", "v", "floor")
    return first.union(meet(sent))


def top_k(rows: DataFrame, is_query, k: int = 5, **kwargs) -> DataFrame:
    """query_id, rank, vec_id, score."""
    best = nearest(rows, is_query, k, **kwargs).groupBy("row", "query_id").agg(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id", "found")).alias("all"))
    cut = best.select("query_id", F.posexplode(F.slice(F.sort_array("all"), 1, k)).alias("at", "hit"))
    return cut.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.less")).alias("score"))


def op1_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(quantised(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v, row_number() OVER () AS i FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.i AS q, q.vec_id AS query_id, r.i, r.vec_id, CAST(list_inner_product(q.v, r.v) AS BIGINT) AS score
  FROM v q JOIN v r ON q.i <> r.i AND q.vec_id % 50 = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM t WHERE rank <= 5
"""
