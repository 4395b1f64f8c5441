"""Code bases with known figures: types, methods, edges, technologies, incremental builds, events, exports."""

import pytest
from pyspark.sql import functions as F

from codeweft.functions import scalars as S
from codeweft.operators import analysis as A
from codeweft.operators import community as C
from codeweft.operators import exports as E
from codeweft.operators import lookups as L
from codeweft.operators import mutate as M
from codeweft.operators import setops as D
from codeweft.operators import traverse as T
from codeweft.operators import vectors as X
from codeweft.plans import build as B
from codeweft.plans import queries
from codeweft.sources import files as F_
from codeweft.sources.java import backend, extract_types, parse_source
from codeweft.storage import load_version, pinned, save_version
from codeweft.streaming import events as V


def write(folder, **sources):
    for name, text in sources.items():
        (folder / f"{name}.java").write_text(text)
    return str(folder)


ZOO = {
    "Animal": "package zoo; public abstract class Animal implements Named { protected String n; Animal(String n) { this.n = n; } public String name() { return n; } abstract void speak(); }",
    "Named": "package zoo; public interface Named { String name(); }",
    "Dog": "package zoo; public class Dog extends Animal { Dog() { super(\"dog\"); } void speak() { bark(); } private void bark() { } }",
    "Cat": "package zoo; public class Cat extends Animal { Cat() { super(\"cat\"); } }",
}


@pytest.fixture(scope="module")
def zoo(spark, tmp_path_factory):
    root = write(tmp_path_factory.mktemp("zoo"), **ZOO)
    return B.build(spark, root)


def counts(graph):
    return {r["type"]: r["edges"] for r in A.edge_counts(graph).collect()}


def test_inheritance(zoo):
    assert counts(zoo) == {"CONTAINS": 8, "EXTENDS": 2, "IMPLEMENTS": 1, "CALLS": 1}
    row = A.node_counts(zoo).first()
    assert (row["types"], row["external"], row["methods"]) == (4, 0, 8)


def test_kinds_and_constructs():
    found = parse_source('package p; import java.util.*; import static a.B.c; @A(x = "}") public enum E { ONE(1), TWO(2) { int f() { return 1; } }; private final int v; E(int v) { this.v = v; } static { int q = 1; } class In {} } record R(int a, @N String b) { R { } <T extends X> T of(T t) throws java.io.IOException { return map(S::t, new Q()); } } @interface An { int v() default 3; }')
    by = {t["simple_name"]: t for t in found}
    assert {k: t["kind"] for k, t in by.items()} == {"E": "ENUM", "In": "CLASS", "R": "RECORD", "An": "ANNOTATION"}
    assert by["In"]["fqn"] == "p.E.In"
    assert [(c["name"], c["arguments"]) for c in by["E"]["enum_constants"]] == [("ONE", ["1"]), ("TWO", ["2"])]
    assert by["E"]["annotations"] == ['@A(x = "}")'] and len(by["E"]["static_initializers"]) == 1
    assert [i["is_wildcard"] for i in by["E"]["import_nodes"]] == [True, False]
    assert [p["name"] for p in by["R"]["record_components"]] == ["a", "b"]
    method = by["R"]["methods"][0]
    assert method["thrown_exceptions"] == ["java.io.IOException"] and method["method_references"] == ["S::t"]
    assert method["internal_method_calls"] == ["map"] and method["signature"] == "<T extends X> T of(T t) throws java.io.IOException"
    assert by["An"]["methods"] == []


def test_other_profile_and_garbage(spark):
    assert parse_source("class A<T> { void f() throws X { } }", "treesitter")[0]["type_parameters"] == []
    files = spark.createDataFrame([("a.java", "]]] }{ class"), ("b.java", "class B {}"), ("c.java", None)], "path string, source string")
    assert [r["fqn"] for r in extract_types(files).collect()] == ["B"]
    assert backend("  ") == "jparser"
    with pytest.raises(ValueError):
        backend("other")


def test_imports_rules_and_dependence(spark, tmp_path):
    root = write(tmp_path, Config="package app; public class Config {}", Service="package app; import app.Config; import javax.ws.rs.GET; @Path(\"/x\") public class Service { @Inject Config c; @GET public String get() { return c.toString(); } }")
    graph = B.build(spark, root)
    assert counts(graph)["DEPENDS_ON"] == 1 and counts(graph)["USES"] == 2
    assert [r["name"] for r in L.injected_fields(graph.types).collect()] == ["c"]
    assert L.deprecated_imports(graph.types).count() == 1 and L.ejb_boundaries(graph.types).count() == 0
    assert L.annotation_total(graph.types).agg(F.sum("annotations")).first()[0] == 3
    assert A.bill_of_technologies(L.rule_hits(graph.types, F_.load_rules(spark))).count() == 2


def test_rules_override_by_id(spark):
    own = spark.createDataFrame([("jpa", "Mine", "mine", ([], [], [], []))], "id string, name string, category string, match struct<annotations:array<string>,importPrefixes:array<string>,superClasses:array<string>,interfaces:array<string>>")
    rules = F_.load_rules(spark, registered=own)
    assert rules.count() == 8 and rules.where("id = 'jpa'").first()["name"] == "Mine"


def test_incremental_equals_full(spark, tmp_path):
    root = write(tmp_path, **ZOO)
    files = F_.scan_sources(spark, root)
    types = pinned(extract_types(files), "old-types")
    manifest = spark.createDataFrame(files.select("path", "sha256").collect(), "path string, sha256 string")
    assert types.count() == 4
    (tmp_path / "Cat.java").unlink()
    (tmp_path / "Dog.java").write_text(ZOO["Dog"].replace("bark", "woof"))
    (tmp_path / "Emu.java").write_text("package zoo; class Emu extends Animal { Emu() { super(null); } }")
    again = F_.scan_sources(spark, root)
    new, _ = B.incremental_types(types, manifest, again)
    full = extract_types(again)
    assert sorted(r["fqn"] for r in new.collect()) == sorted(r["fqn"] for r in full.collect())
    assert B.graph_of(new).edges.exceptAll(B.graph_of(full).edges).count() == 0
    F_.save_manifest(manifest, str(tmp_path / "manifest"))
    assert F_.load_manifest(spark, str(tmp_path / "manifest")).count() == 4
    assert F_.load_manifest(spark, str(tmp_path / "none")).count() == 0


def test_versions_communities_and_diff(spark, zoo, tmp_path):
    place = save_version(zoo, str(tmp_path), 0)
    back = load_version(spark, place, ("nodes", "edges", "methods", "types"))
    assert back.edges.count() == zoo.edges.count()
    fqns = {r["fqn"]: r["community_id"] for r in back.classes().collect()}
    assert fqns["zoo.Animal"] == fqns["zoo.Dog"]
    smaller = M.delete_types(back, spark.createDataFrame([("zoo.Cat",)], "fqn string"))
    assert [tuple(r) for r in D.type_changes(smaller, back).collect()] == [("zoo.Cat", "added")]
    assert smaller.edges.where("from_id LIKE '%zoo.Cat%' OR to_id LIKE '%zoo.Cat%'").count() == 0


def test_girvan_newman_splits_two_triangles(spark):
    names = "abcdef"
    nodes = spark.createDataFrame([(f"class:{n}", "CLASS", n, n, False, None, "PENDING") for n in names], "id string, kind string, fqn string, simple_name string, external boolean, community_id long, status string")
    pairs = ["ab", "bc", "ac", "cd", "de", "ef", "df"]
    edges = spark.createDataFrame([("DEPENDS_ON", f"class:{p[0]}", f"class:{p[1]}", 3.0, "EXTRACTED", 1.0) for p in pairs], "type string, from_id string, to_id string, weight double, provenance string, confidence_score double")
    graph = B.Graph(nodes, edges)
    labels = {r["fqn"]: r["label"] for r in C.girvan_newman(graph, 2).collect()}
    assert labels["a"] == labels["b"] == labels["c"] != labels["d"] == labels["e"] == labels["f"]
    assert T.shortest_path(graph, "a", "f").first()["hops"] == ["a", "c", "d", "f"]
    assert T.explain_path(T.shortest_path(graph, "a", "f")).first()["explanation"].startswith("Path (4 hops): a")
    order = [r["fqn"] for r in T.depth_first(graph, "a", 4).orderBy("place").collect()]
    assert order[:3] == ["a", "b", "c"]


def test_registered_paths_have_no_bound(spark, monkeypatch):
    names = "abcdefghijk"
    nodes = spark.createDataFrame([(f"class:{n}", "INTERFACE", n, n, False, None, "PENDING") for n in names], "id string, kind string, fqn string, simple_name string, external boolean, community_id long, status string")
    edges = spark.createDataFrame([("DEPENDS_ON", f"class:{x}", f"class:{y}", 3.0, "EXTRACTED", 1.0) for x, y in zip(names, names[1:])], "type string, from_id string, to_id string, weight double, provenance string, confidence_score double")
    monkeypatch.setattr(queries, "commerce", lambda spark, sf: B.Graph(nodes, edges))
    assert tuple(queries.QUERIES["gra5_shortest_path"](spark, "").first()) == ("a", "k", 11)


def test_events(spark, zoo, tmp_path):
    start = save_version(zoo, str(tmp_path / "g"), 0)
    sig = "private void bark()"
    rows = [("SIGNATURE_CHANGED", f"method:zoo.Dog#{sig}", None, sig, "void bark(int n)", None, 1), ("NODE_MIGRATED", "class:zoo.Cat", None, None, None, "x", 2), ("NODE_SPLIT", "class:zoo.Named", ["a"], None, None, None, 3)]
    schema = "kind string, node_id string, new_node_ids array<string>, old_signature string, new_signature string, new_file_path string, timestamp long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    V.mutate_stream(stream, start, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    after = load_version(spark, str(tmp_path / "out/v=0"))
    ids = {r["id"]: r["status"] for r in after.nodes.collect()}
    assert "method:zoo.Dog#void bark(int n)" in ids and f"method:zoo.Dog#{sig}" not in ids
    assert ids["class:zoo.Cat"] == "MIGRATED" and "class:zoo.Named" not in ids
    assert after.edges.where("to_id = 'class:zoo.Named'").count() == 0


def test_exports(zoo, tmp_path):
    E.write_lines(E.graphml(zoo), str(tmp_path / "g"))
    lines = [x for p in sorted((tmp_path / "g").glob("part*")) for x in p.read_text().splitlines()]
    assert lines[0].startswith("<?xml") and lines[-1] == "</graphml>".join(["</graph>", ""]) and sum("<node " in x for x in lines) == 4
    assert "zoo.Dog" in "".join(r["line"] for r in E.cypher(zoo).collect())
    assert {r["file"] for r in E.wiki(A.insights(zoo)).collect()} >= {"index.md"}


def test_module_descriptor(spark):
    files = spark.createDataFrame([("m", "open module a.b { requires transitive java.sql; exports a.b.c; uses x.Y; // requires no\n }")], "path string, source string")
    row = F_.module_descriptors(files).first()
    assert (row["name"], row["is_open"], row["requires"], row["exports"], row["uses"], row["provides"]) == ("a.b", True, ["java.sql"], ["a.b.c"], ["x.Y"], [])


def test_scalar_edges(spark):
    one = spark.range(1)

    def value(column):
        return one.select(column.alias("x")).first()["x"]

    def vector(*xs):
        return F.array(*[F.lit(float(x)) for x in xs])

    assert value(S.cosine(vector(1, 0), vector(1, 0))) == 1 and value(S.cosine(vector(1, 0), vector(-1, 0))) == -1
    assert value(S.cosine(vector(0, 0), vector(1, 0))) == 0 and value(S.cosine(F.lit(None).cast("array<double>"), vector(1))) == 0
    with pytest.raises(Exception, match="differ"):
        value(S.cosine(vector(1), vector(1, 2)))
    assert value(S.class_fqn_from_method_id(F.lit("method:#x"))) == "#x" and value(S.signature_from_method_id(F.lit("method:a"))) == ""
    assert value(S.annotation_name(F.lit('@Table(name = "ORDERS")'))) == "Table"
    assert value(S.token_estimate(F.lit("  "))) == 0 and value(S.token_estimate(F.lit("ab"))) == 1
    with pytest.raises(Exception, match="unknown language"):
        value(S.language_of(F.lit("a.xyz")))


def test_command_line(spark, tmp_path, capsys):
    from codeweft.cli import main

    root = write(tmp_path, **ZOO)
    assert main(["build", "-p", root, "--svg"], spark) == 0
    assert main(["path", "-p", root, "Dog", "Cat"], spark) == 0
    assert main(["query", "-p", root, "what extends Animal"], spark) == 0
    assert main(["explain", "-p", root, "Dog"], spark) == 0
    out = capsys.readouterr().out
    assert "Path (3 hops): Dog → Animal → Cat" in out and "[depth 0] zoo.Animal" in out and "in package zoo is a class" in out
    (tmp_path / ".git").mkdir()
    assert main(["hook", "-p", root, "install"], spark) == 0 and main(["hook", "-p", root, "uninstall"], spark) == 0
    assert capsys.readouterr().out.split() == ["INSTALLED", "NOT_INSTALLED"]
    assert main(["save-result", "-p", root, "--question", "q", "--answer", "a", "--nodes", "x,y"], spark) == 0
    (tmp_path / "Emu.java").write_text("package zoo; class Emu extends Animal { Emu() { super(null); } }")
    assert main(["build", "-p", root, "--update", "--no-viz"], spark) == 0
    assert main(["path", "-p", root, "Emu", "Cat"], spark) == 0
    (tmp_path / "Emu.java").unlink()
    assert main(["build", "-p", root, "--update", "--no-viz"], spark) == 0
    capsys.readouterr()
    assert main(["path", "-p", root, "Emu", "Cat"], spark) == 1


def test_merged_graphs_keep_methods_and_types_of_both(spark, zoo, tmp_path):
    other = B.build(spark, write(tmp_path, Dog="package zoo; class Dog { void dig() { } void speak() { } }", Owl="package zoo; class Owl { void hoot() { } }"))
    merged = D.merge_graphs(zoo, other)
    found = {(r["fqn"], r["name"]) for r in merged.methods.collect()}
    assert {("zoo.Dog", "dig"), ("zoo.Dog", "bark"), ("zoo.Owl", "hoot")} <= found and len(found) == merged.methods.select("fqn", "signature").distinct().count()
    assert merged.types.where("fqn = 'zoo.Dog'").count() == 1 and merged.types.where("fqn = 'zoo.Owl'").count() == 1


def test_user_rules_and_vector_blobs(spark, zoo):
    hits = L.custom_hits(zoo.types, ("dogs", "Dogs", "pets"), lambda rows: rows["simple_name"].str.startswith("D"), ["simple_name"])
    assert [tuple(r) for r in hits.collect()] == [("zoo.Dog", "dogs", "Dogs", "pets")]
    vectors = spark.createDataFrame([("a", [1.0, 2.0, 3.0]), ("b", None)], "fqn string, vector array<float>")
    blobs = X.encode_vectors(vectors)
    assert blobs.collect()[0]["vector"] == bytes.fromhex("0000803f0000004000004040")
    assert X.decode_vectors(blobs).collect() == vectors.collect()


def test_embedder_and_deep_build(spark, tmp_path):
    body = "int run(int total) { return total + fee + fee; }"
    root = write(tmp_path, Left=f"package d; class Left {{ {body} }}", Right=f"package d; class Right {{ {body} }}")
    graph = B.build(spark, root, B.BuildOptions(deep=True))
    edge = graph.edges.where("type = 'SEMANTICALLY_SIMILAR'").first()
    assert (edge["from_id"], edge["to_id"], edge["provenance"]) == ("class:d.Left", "class:d.Right", "INFERRED") and edge["weight"] > 0.99
    found = X.search(X.embed(graph.methods), X.embed(graph.methods).where("kind = 'CLASS'").first()["vector"], 5, 0.9).collect()
    assert [r["fqn"] for r in found] == ["d.Left", "d.Right"]
