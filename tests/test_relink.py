"""Relinking what changed against building the whole graph, over random edits."""

import random

import pytest
from pyspark.sql import functions as F

from codeweft.operators import setops as D
from codeweft.plans import build as B
from codeweft.sources import files as S
from codeweft.storage import pinned


def content(graph):
    return {t: sorted(tuple(str(x) for x in r) for r in getattr(graph, t).select(*columns).collect()) for t, columns in (("nodes", ["id", "kind", "fqn", "simple_name", "external", "status"]), ("edges", ["type", "from_id", "to_id", "weight"]), ("methods", ["fqn", "signature", "calls"]))}


def source(rng, i, n):
    others = [f"import p{j % 3}.T{j};" for j in sorted({rng.randrange(n) for _ in range(rng.randrange(4))}) if j != i]
    head = rng.choice(["", f" extends T{rng.randrange(n)}", " implements Runnable", " extends java.util.ArrayList"])
    extra = rng.choice(["", "import jakarta.persistence.Entity;", "import org.springframework.stereotype.Service;"])
    mark = {"": "", "import jakarta.persistence.Entity;": "@Entity ", "import org.springframework.stereotype.Service;": "@Service "}[extra]
    body = " ".join(f"void m{k}() {{ m{rng.randrange(4)}(); }}" for k in range(rng.randrange(4)))
    more = f" class Extra{i} {{ int f; }}" if rng.random() < 0.3 else ""
    return f"package p{i % 3}; {' '.join(others)} {extra} {mark}public class T{i}{head} {{ {body} }}{more}"


@pytest.mark.parametrize("seed", [1, 2])
def test_relinked_equals_built(spark, tmp_path, seed):
    rng, n = random.Random(seed), 14
    root = tmp_path / "src"
    root.mkdir()
    rules = S.load_rules(spark)
    for i in range(n):
        if rng.random() < 0.8:
            (root / f"T{i}.java").write_text(source(rng, i, n))
    files = S.scan_sources(spark, str(root))
    types, manifest = pinned(B.extract_types(files, None), "types"), pinned(files.select("path", "sha256"), "manifest")
    graph = B.graph_of(types, rules)
    graph = graph.with_(nodes=pinned(graph.nodes, "n"), edges=pinned(graph.edges, "e"))
    for _ in range(3):
        for i in rng.sample(range(n), 4):  # edit, add or delete
            path = root / f"T{i}.java"
            if path.exists() and rng.random() < 0.4:
                path.unlink()
            else:
                path.write_text(source(rng, i, n))
        files = S.scan_sources(spark, str(root))
        diff = pinned(D.manifest_diff(manifest, files.select("path", "sha256")), "diff")
        new_types, _ = B.incremental_types(graph.types, manifest, files)
        stale = diff.where("state <> 'unchanged'").select(F.col("path").alias("file_path"))
        whole = B.graph_of(new_types, rules)
        graph = B.relink(graph, new_types, stale, rules)
        assert content(graph) == content(whole)
        manifest = pinned(files.select("path", "sha256"), "manifest")


def test_edges_of_untouched_types_are_taken_over(spark, tmp_path):
    root = tmp_path / "src"
    root.mkdir()
    for name, text in {"A": "package p; import p.B; class A { void f() { g(); } void g() { } }", "B": "package p; class B { }", "C": "package p; import p.D; class C { }"}.items():
        (root / f"{name}.java").write_text(text)
    files = S.scan_sources(spark, str(root))
    types = pinned(B.extract_types(files, None), "types")
    graph = B.graph_of(types)
    marked = graph.with_(edges=pinned(graph.edges.withColumn("provenance", F.lit("TAKEN")), "marked"))
    manifest = pinned(files.select("path", "sha256"), "manifest")
    (root / "D.java").write_text("package p; class D { }")
    new_types, _ = B.incremental_types(types, manifest, S.scan_sources(spark, str(root)))
    after = B.relink(marked, new_types, new_types.where("simple_name = 'D'").select("file_path"))
    kinds = {(r["type"], r["from_id"], r["to_id"]): r["provenance"] for r in after.edges.collect()}
    assert kinds.pop(("DEPENDS_ON", "class:p.C", "class:p.D")) == "EXTRACTED" and set(kinds.values()) == {"TAKEN"}
