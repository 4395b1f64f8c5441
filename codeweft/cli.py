"""Command line: build, query, path, explain, export, watch, hook, cluster-only, merge, save-result."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import __version__, hooks
from .graph import Graph
from .operators import analysis as A
from .operators import community as C
from .operators import exports as E
from .operators import lookups as L
from .operators import setops as D
from .operators import traverse as T
from .plans import build as B
from .schemas import QA
from .sources import files as S
from .storage import load_version, pinned, save_version, store_location

ALL = ("nodes", "edges", "methods", "types")


def _versions(spark: SparkSession, store: str) -> list[int]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(int(f.getPath().getName()[2:]) for f in fs.listStatus(path) if f.getPath().getName().startswith("v=")) if fs.exists(path) else []


def _load(spark: SparkSession, store: str) -> Graph:
    found = _versions(spark, store)
    if not found:
        raise SystemExit(f"no graph in {store}; build one first")
    return load_version(spark, f"{store}/v={found[-1]}", ALL)


def _save(spark: SparkSession, store: str, graph: Graph) -> str:
    return save_version(graph, store, (_versions(spark, store) or [-1])[-1] + 1)


def _first(df: DataFrame, default=None):
    row = df.first()
    return default if row is None else row[0]


def _resolve(spark: SparkSession, graph: Graph, name: str) -> str | None:
    return _first(L.resolve_names(graph, spark.createDataFrame([(name,)], "q string")).select("fqn"))


def export(graph: Graph, kind: str, out: str) -> None:
    if kind == "wiki":
        E.wiki(A.insights(graph)).write.mode("overwrite").json(f"{out}/wiki")
    elif kind == "svg":
        rows = E.svg_grid(graph).select(F.lit(1).alias("part"), F.col("fqn").alias("at"), F.col("svg").alias("line"))
        spark = graph.nodes.sparkSession
        frame = spark.createDataFrame([(0, "", '<svg xmlns="http://www.w3.org/2000/svg" width="800" height="600">'), (2, "", "</svg>")], "part int, at string, line string")
        E.write_lines(frame.union(rows), f"{out}/graph.svg")
    else:
        make, name = {"html": (E.graph_html, "graph.html"), "graphml": (E.graphml, "graph.graphml"), "neo4j": (E.cypher, "cypher.txt"), "json": (E.graph_json, "graph.json")}[kind]
        E.write_lines(make(graph), f"{out}/{name}")


def build(spark: SparkSession, a: argparse.Namespace) -> int:
    store, began = store_location(a.path), time.time()
    options = B.BuildOptions(backend=a.parser_backend, incremental=a.update, deep=a.mode == "deep", clustering=a.clustering)
    before = _versions(spark, store)
    if a.update and before:
        old = _load(spark, store)
        files = S.scan_sources(spark, a.path)
        known = S.load_manifest(spark, f"{store}/manifest")
        stale = pinned(D.manifest_diff(known, files.select("path", "sha256")).where("state <> 'unchanged'").select(F.col("path").alias("file_path")), "stale")
        types, manifest = B.incremental_types(old.types, known, files, options.backend)
        graph = B.relink(old, types, stale, S.load_rules(spark))
        graph = C.cluster(B.deepen(graph) if options.deep else graph, options.clustering)
        D.diff_summary(old, graph).show(truncate=False)
    else:
        graph, manifest = B.build(spark, a.path, options), S.scan_sources(spark, a.path).select("path", "sha256")
    place = _save(spark, store, graph)
    S.save_manifest(manifest, f"{store}/manifest")
    graph = load_version(spark, place, ALL)
    E.write_lines(E.report(A.graph_stats(graph), A.hubs(graph), A.surprising(graph), A.suggested_questions(graph), A.insights(graph)), f"{store}/report.md")
    for kind in ["json"] + ["html"] * (not a.no_viz) + ["wiki"] * a.wiki + ["svg"] * a.svg + ["graphml"] * a.graphml + ["neo4j"] * a.neo4j:
        export(graph, kind, store)
    A.graph_stats(graph).show(truncate=False)
    print(f"built {place} in {time.time() - began:.1f} s")
    return 0


def ask(spark: SparkSession, a: argparse.Namespace) -> int:
    graph = _load(spark, store_location(a.path))
    names = graph.classes().select("fqn", F.explode(F.array_distinct(F.array("fqn", "simple_name"))).alias("name")).where(F.contains(F.lit(a.question.lower()), F.lower("name")))
    seeds = names.select("fqn").distinct().orderBy("fqn").limit(3).withColumn("rank", F.row_number().over(Window.orderBy("fqn")))
    if a.dfs:
        first = _first(seeds.orderBy("rank").select("fqn"))
        steps = T.depth_first(graph, first) if first else T.breadth_first(graph, seeds, 0)
    else:
        steps = T.breadth_first(graph, seeds)
    print(_first(T.answer_text(graph, steps, a.question, a.budget)))
    return 0


def path(spark: SparkSession, a: argparse.Namespace) -> int:
    graph = _load(spark, store_location(a.path))
    ends = [_resolve(spark, graph, x) for x in (a.source, a.target)]
    if None in ends:
        print("Could not resolve one or both types.")
        return 1
    row = T.explain_path(T.shortest_path(graph, *ends)).first()
    print(row["explanation"])
    return 0 if row["hops"] else 1


def explain(spark: SparkSession, a: argparse.Namespace) -> int:
    graph = _load(spark, store_location(a.path))
    fqn = _resolve(spark, graph, a.node)
    text = fqn and _first(T.explain_types(graph, spark.createDataFrame([(fqn,)], "fqn string"), A.labels(graph)).select("sentence"))
    print(text or f"No type found matching: {a.node}")
    return 0


def hook(spark, a: argparse.Namespace) -> int:
    if a.action != "status":
        getattr(hooks, a.action)(a.path)
    print(hooks.status(a.path))
    return 0


def cluster_only(spark: SparkSession, a: argparse.Namespace) -> int:
    store = store_location(a.path)
    print(_save(spark, store, C.cluster(_load(spark, store), a.clustering)))
    return 0


def merge(spark: SparkSession, a: argparse.Namespace) -> int:
    print(_save(spark, a.primary, D.merge_graphs(_load(spark, a.primary), _load(spark, a.secondary), a.repo, a.prefix_edges)))
    return 0


def save_result(spark: SparkSession, a: argparse.Namespace) -> int:
    now = time.time_ns()
    row = (now, a.question, a.answer, [x for x in (a.nodes or "").split(",") if x], now // 1_000_000)
    spark.createDataFrame([row], QA).write.mode("append").parquet(f"{store_location(a.path)}/qa")
    return 0


def watch(spark: SparkSession, a: argparse.Namespace) -> int:
    from .streaming.watch import watch as start

    start(spark, a.path, lambda rows: build(spark, a), f"{store_location(a.path)}/watch", a.debounce).awaitTermination()
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="codeweft", description=__doc__)
    p.add_argument("--version", action="version", version=__version__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, run, *arguments: str):
        c = sub.add_parser(name)
        c.set_defaults(run=run)
        c.add_argument("-p", "--path", default=".")
        for x in arguments:
            c.add_argument(x)
        return c

    for name, run in (("build", build), ("watch", watch)):
        c = command(name, run)
        c.add_argument("--parser-backend")
        c.add_argument("--mode", choices=("standard", "deep"), default="standard")
        c.add_argument("--clustering", choices=tuple(C.ALGORITHMS), default="label-propagation")
        c.add_argument("--debounce", type=int, default=3)
        c.add_argument("--update", action="store_true", default=name == "watch")
        for flag in ("no-viz", "wiki", "svg", "graphml", "neo4j"):
            c.add_argument(f"--{flag}", action="store_true")
    c = command("query", ask, "question")
    c.add_argument("--dfs", action="store_true")
    c.add_argument("--budget", type=int, default=3000)
    command("path", path, "source", "target")
    command("explain", explain, "node")
    command("export", lambda spark, a: export(_load(spark, store_location(a.path)), a.kind, store_location(a.path)) or 0).add_argument("kind", choices=("html", "graphml", "svg", "neo4j", "wiki", "json"))
    command("hook", hook).add_argument("action", choices=("install", "uninstall", "status"))
    command("cluster-only", cluster_only).add_argument("--clustering", choices=tuple(C.ALGORITHMS), default="label-propagation")
    c = command("merge", merge, "primary", "secondary")
    c.add_argument("--repo", default="secondary")
    c.add_argument("--prefix-edges", action="store_true")
    c = command("save-result", save_result)
    c.add_argument("--question", required=True)
    c.add_argument("--answer", required=True)
    c.add_argument("--nodes")
    return p


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(arguments)
    return a.run(spark or SparkSession.builder.appName("codeweft").getOrCreate(), a)


if __name__ == "__main__":
    raise SystemExit(main())
