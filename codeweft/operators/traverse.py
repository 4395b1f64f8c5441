"""Traversals as joins of a frontier with the neighbours: hops, breadth and depth first, shortest paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import package_of, simple_name
from ..graph import Graph
from ..schemas import PATH_TYPES, TRAVERSAL_TYPES
from ..storage import pinned
from .exports import numbered


def k_hops(graph: Graph, starts: DataFrame, depth: int, types=TRAVERSAL_TYPES) -> DataFrame:
    """(start, fqn, depth) of all that is within ``depth`` undirected hops of each start; starts left out."""
    near = pinned(graph.neighbours(types).select("fqn", "other").distinct(), "hops-near")
    seen = starts.select(F.col("fqn").alias("start"), "fqn", F.lit(0).alias("depth")).distinct()
    frontier = seen
    for d in range(1, depth + 1):
        step = frontier.join(near, "fqn").select("start", F.col("other").alias("fqn")).distinct().join(seen.select("start", "fqn"), ["start", "fqn"], "left_anti")
        frontier = pinned(step.withColumn("depth", F.lit(d)), "hops-frontier")
        seen = seen.union(frontier)
    return seen.where("depth > 0")


def _step_key(types) -> Column:
    order = F.coalesce(*[F.when(F.col("type") == t, F.lit(i)) for i, t in enumerate(types)])
    return F.concat(F.lpad(order.cast("string"), 2, "0"), F.lit(":"), F.col("other"))


def _next_to(graph: Graph, some: DataFrame, types) -> DataFrame:
    """(fqn, type, other): the neighbours of ``some`` (fqn) alone, with no shuffle of all others where ``some`` are few."""
    return graph.ends(types).join(some.select("fqn"), "fqn", "left_semi").distinct()


def breadth_first(graph: Graph, seeds: DataFrame, depth: int = 3, types=TRAVERSAL_TYPES) -> DataFrame:
    """(fqn, depth, from_fqn, via, place) from ranked seeds (fqn, rank).

    ``place`` is the array of steps from the seed; arrays of one length compare in the order in which a
    queue would visit, so the first parent is a minimum and no global ranking is needed.
    """
    # One step asks only for what is next to the seeds; more steps use all neighbours again.
    near = pinned(graph.neighbours(types), "steps-near") if depth > 1 else _next_to(graph, seeds, types)
    first = seeds.select("fqn", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("from_fqn"), F.lit(None).cast("string").alias("via"), F.array(F.lpad(F.col("rank").cast("string"), 6, "0")).alias("place"))
    seen, frontier = first, first
    for d in range(1, depth + 1):
        step = frontier.select("fqn", "place").join(near, "fqn").select(F.col("other").alias("to"), F.concat("place", F.array(_step_key(types))).alias("place"), F.col("fqn").alias("from_fqn"), F.col("type").alias("via"))
        best = step.groupBy("to").agg(F.min(F.struct("place", "from_fqn", "via")).alias("best"))
        found = best.select(F.col("to").alias("fqn"), F.lit(d).alias("depth"), "best.from_fqn", "best.via", "best.place")
        frontier = pinned(found.join(seen.select("fqn"), "fqn", "left_anti"), "steps-frontier")
        seen = seen.unionByName(frontier)
    return seen


#: Width of a step in a place: two digits for the type, twelve for the other's number.
_STEP = 14


def depth_first(graph: Graph, seed: str, depth: int = 4, types=TRAVERSAL_TYPES) -> DataFrame:
    """(place, fqn, depth, from_fqn, via) in preorder. A node counts as visited even where it is too deep to be listed.

    A walk tries steps in the order of their paths, so a node's path is the least of the tries from nodes that
    are listed. All paths are worked out at once, from those of the round before, until none changes: what is
    then left has one solution, and each round settles at least the next node of the order, as a rule far more.
    """
    spark = graph.nodes.sparkSession
    near = pinned(graph.pairs(types), "walk-near")  # names travel once for an edge; repeats do no harm to a minimum
    names = pinned(numbered(near.select("fqn").union(near.select("other")).distinct(), ["fqn"], "n"), "walk-names")
    first = names.where(F.col("fqn") == seed).select("n").first()
    if first is None:
        return spark.createDataFrame([(0, seed, 0, None, None)], "place long, fqn string, depth int, from_fqn string, via string")
    order = F.coalesce(*[F.when(F.col("type") == t, F.lit(i)) for i, t in enumerate(types)])
    steps = near.join(names.select("fqn", F.col("n").alias("at")), "fqn").join(names.select(F.col("fqn").alias("other"), F.col("n").alias("to")), "other")
    ways = F.array(F.struct("at", "to"), F.when(F.col("both"), F.struct(F.col("to").alias("at"), F.col("at").alias("to"))))
    steps = steps.select(order.cast("int").alias("kind"), F.explode(F.array_compact(ways)).alias("way")).select("way.at", "way.to", "kind")
    steps = pinned(steps, "walk-steps")
    step = F.concat("path", F.lpad(F.col("kind").cast("string"), 2, "0"), F.lpad(F.hex("to"), 12, "0"))
    start = spark.createDataFrame([(first[0], "")], "at long, path string")
    now, many = start, 1
    while True:
        tries = now.where(F.length("path") <= _STEP * depth).join(steps, "at").select(F.col("to").alias("at"), step.alias("path"))
        new = pinned(tries.union(start).groupBy("at").agg(F.min("path").alias("path")), "walk-paths")
        count = new.count()
        same = count == many and not new.join(now, ["at", "path"], "left_anti").limit(1).count()
        now, many = new, count
        if same:
            break
    listed = numbered(now.where(F.length("path") <= _STEP * depth), ["path"], "place")

    parent = F.conv(F.substring("path", 2 - 2 * _STEP, 12), 16, 10).try_cast("long")
    deep = (F.length("path") / _STEP).cast("int")
    kind = F.substring("path", -_STEP, 2).try_cast("int")
    rows = listed.select("place", "at", deep.alias("depth"), F.when(deep == 1, first[0]).when(deep > 1, parent).alias("before"), F.when(deep > 0, F.element_at(F.array(*map(F.lit, types)), kind + 1)).alias("via"))
    rows = rows.join(names.select(F.col("n").alias("at"), "fqn"), "at").join(names.select(F.col("n").alias("before"), F.col("fqn").alias("from_fqn")), "before", "left")
    return rows.select("place", "fqn", "depth", "from_fqn", "via")


def answer_text(graph: Graph, steps: DataFrame, question: str, budget: int = 3000, types=TRAVERSAL_TYPES) -> DataFrame:
    """One text: each step with its neighbours, cut to four characters a token, 200 at least."""
    near = _next_to(graph, steps, types).groupBy("fqn").agg(F.sort_array(F.collect_set("other")).alias("others"))
    via = F.when(F.col("via").isNotNull(), F.concat(F.lit(" (via "), "via", F.lit(" from "), "from_fqn", F.lit(")"))).otherwise("")
    others = F.array_join(F.transform(F.coalesce("others", F.array().cast("array<string>")), lambda o: F.concat(F.lit("    → "), o, F.lit("\n"))), "")
    line = F.concat(F.lit("- [depth "), F.col("depth").cast("string"), F.lit("] "), "fqn", via, F.lit("\n"), others)
    lines = steps.join(near, "fqn", "left").agg(F.sort_array(F.collect_list(F.struct("depth", "place", line.alias("line")))).alias("lines"))
    whole = F.concat(F.lit(f"Query: {question}\n\n"), F.array_join(F.transform("lines", lambda x: x["line"]), ""))
    text = F.when(F.size("lines") == 0, F.lit("No matching types found for query.")).otherwise(F.substring(whole, 1, max(200, 4 * budget)))
    return lines.select(text.alias("answer"))


def shortest_path(graph: Graph, a: str, b: str, types=PATH_TYPES) -> DataFrame:
    """(source, target, hops): the first of the shortest paths between internal types; empty hops if none.

    Searches back from the target until the source is met or the frontier is empty, however far that is; the
    path then takes, hop by hop, the least of the types that are nearer to the target.
    """
    spark = graph.nodes.sparkSession

    def answer(hops: list[str]) -> DataFrame:
        return spark.createDataFrame([(a, b, hops)], "source string, target string, hops array<string>")

    if a == b:
        return answer([a])
    inside = pinned(graph.classes().select("fqn"), "path-types")
    links = pinned(graph.class_links().where(F.col("type").isin(*types)).select("a", "b"), "path-links")

    def around(some: DataFrame) -> DataFrame:
        """Internal neighbours of ``some`` (fqn)."""
        met = links.join(some.select(F.col("fqn").alias("b")), "b", "left_semi").select(F.col("a").alias("fqn")).union(links.join(some.select(F.col("fqn").alias("a")), "a", "left_semi").select(F.col("b").alias("fqn")))
        return met.distinct().join(inside, "fqn", "left_semi")

    levels = [pinned(inside.where(F.col("fqn") == b), "path-frontier")]
    while not levels[-1].where(F.col("fqn") == a).limit(1).count():
        # What is next to a level lies in it or beside it: only the last two can be met again.
        new = around(levels[-1])
        for seen in levels[-2:]:
            new = new.join(seen, "fqn", "left_anti")
        levels.append(pinned(new, "path-frontier"))
        if not levels[-1].limit(1).count():
            return answer([])
    hops = [a]
    for level in reversed(levels[:-1]):
        here = spark.createDataFrame([(hops[-1],)], "fqn string")
        hops.append(around(here).join(level, "fqn", "left_semi").agg(F.min("fqn")).first()[0])
    return answer(hops)


def explain_path(paths: DataFrame) -> DataFrame:
    """Adds a sentence (fixed values, like those of ``explain_types`` and ``answer_text``); hops are counted as vertices."""
    text = F.concat(F.lit("Path ("), F.size("hops").cast("string"), F.lit(" hops): "), F.array_join(F.transform("hops", simple_name), " → "), F.lit(". Each hop is a structural relationship in the Java graph."))
    same = F.when(F.col("source") == F.col("target"), "Start and end are the same type.").when(F.size("hops") == 0, "No path found between types.")
    return paths.withColumn("explanation", F.coalesce(same, text))


def explain_types(graph: Graph, fqns: DataFrame, labels: DataFrame, types=TRAVERSAL_TYPES) -> DataFrame:
    """(fqn, sentence): name, package, kind, methods, community and neighbours of each asked type."""
    near = graph.neighbours(types).join(fqns, "fqn", "left_semi").groupBy("fqn").agg(F.sort_array(F.collect_set("other")).alias("others"))
    methods = graph.edges.where("type = 'CONTAINS'").groupBy(F.substr("from_id", F.lit(7)).alias("fqn")).agg(F.count(F.lit(1)).alias("methods"))
    rows = graph.classes().join(fqns, "fqn", "left_semi").join(near, "fqn", "left").join(methods, "fqn", "left").join(labels.select("community_id", "label"), "community_id", "left")
    others = F.coalesce("others", F.array().cast("array<string>"))
    listed = F.when(F.size(others) == 0, "none").otherwise(F.array_join(F.transform(F.slice(others, 1, 5), simple_name), ", "))
    community = F.when(F.col("community_id").isNull(), "unassigned").otherwise(F.coalesce("label", F.concat(F.lit("Community "), F.col("community_id").cast("string"))))
    text = F.format_string("%s (%s) in package %s is a %s with %s methods. It belongs to %s and connects to %s neighbor types: %s.", "simple_name", "fqn", package_of(F.col("fqn")), F.lower("kind"), F.coalesce("methods", F.lit(0)).cast("string"), community, F.size(others).cast("string"), listed)
    return rows.select("fqn", text.alias("sentence"))
