"""Contexts of parsed types as whole documents."""

import json

from codeweft.operators import analysis as A
from codeweft.operators import context as X
from codeweft.plans import build as B

SHOP = {
    "Cart": 'package shop; import jakarta.inject.Inject; @Deprecated public class Cart extends Base implements Priced { @Inject Store store; private int total; Cart() { } public int price() { add(1); return total; } void add(int n) { total += n; } }',
    "Store": "package shop; public class Store { String place; void open() { } }",
    "Base": "package shop; public abstract class Base { protected String id; }",
    "Priced": "package shop; public interface Priced { int price(); }",
}


def shop(spark, tmp_path):
    for name, text in SHOP.items():
        (tmp_path / f"{name}.java").write_text(text)
    return B.build(spark, str(tmp_path))


def test_method_context_is_whole_and_within_its_budget(spark, tmp_path):
    graph = shop(spark, tmp_path)
    asked = spark.createDataFrame([("shop.Cart", "price")], "fqn string, wanted string")
    for budget in (None, 500, 260):
        row = X.method_contexts(graph, asked, budget, A.summaries(graph)).first()
        doc = json.loads(row["context"])
        assert list(doc) == ["t", "c", "cs", "_instructions", "tgt", "nbr"] and doc["t"] == "surgical" and doc["c"] >= 0 and doc["cs"].startswith("Community ")
        assert list(doc["_instructions"]) == ["task", "read_order", "rules", "do_not_request"]
        assert (doc["tgt"]["cls"], doc["tgt"]["fqn"], doc["tgt"]["m"]) == ("Cart", "shop.Cart", "price") and "add(1)" in doc["tgt"]["body"]
        assert [(c["n"], c["rt"]) for c in doc["tgt"]["calls"]] == [("add", "void")]
        assert row["included"] == ["shop.Cart", *(n["fqn"] for n in doc["nbr"])]
        head = {k: v for k, v in doc.items() if k != "nbr"}
        used = len(json.dumps(head, separators=(",", ":"))) // 4
        assert row["tokens"] == used + sum(len(json.dumps(n, separators=(",", ":"))) // 4 for n in doc["nbr"])
        if budget:
            assert row["tokens"] <= budget
        else:
            assert [n["cls"] for n in doc["nbr"]] == ["Base", "Priced"] and doc["nbr"][0]["fields"] == ["String id"]
    assert X.method_contexts(graph, spark.createDataFrame([("shop.Cart", "none")], "fqn string, wanted string")).count() == 0


def test_contexts_are_not_shuffled_and_skeletons_written_once(spark):
    from codeweft.plans.queries import QUERIES, _contexts

    sf = "/root/testdata/sf0.001"
    plans = [QUERIES["agg17_token_benchmark"](spark, sf), _contexts(spark, sf, None)]
    agg, whole = (df._jdf.queryExecution().optimizedPlan().toString() for df in plans)
    # What is asked for meets a method's row as text; the document is not written anew for each of its type's methods.
    assert agg.count("Join") < QUERIES["ctx1_method_context"](spark, sf)._jdf.queryExecution().optimizedPlan().toString().count("Join") + 1
    assert "CALLS" not in whole and whole.count("nbr") and not any("to_json" in line and "nbr:" in line for line in whole.splitlines())
    row = next(r for r in _contexts(spark, sf, None).collect() if r["included"].count(",") > 2)
    doc = json.loads(row["context"])
    assert [n["fqn"] for n in doc["nbr"]] == row["included"].split(",")[1:]
    assert row["tokens"] == sum(len(json.dumps(x, separators=(",", ":"))) // 4 for x in [{k: v for k, v in doc.items() if k != "nbr"}, *doc["nbr"]])


def test_class_contexts(spark, tmp_path):
    graph = shop(spark, tmp_path)
    row = X.class_contexts(graph, spark.createDataFrame([("shop.Cart",)], "fqn string"), 40).first()
    doc = json.loads(row["context"])
    assert list(doc) == ["t", "c", "metadata", "methods"] and row["tokens"] == 40
    assert doc["metadata"]["package_name"] == "shop" and doc["metadata"]["class_name"] == "Cart" and doc["metadata"]["file_path"].endswith("Cart.java")
    assert {m["name"] for m in doc["methods"]} >= {"price", "add"} and list(doc["methods"][0]) == ["name", "signature", "return_type", "raw_body"]
    whole = json.loads(X.surgical_class_contexts(graph.types).where("fqn = 'shop.Cart'").first()["context"])
    assert list(whole) == ["metadata", "class_context", "methods"]
    own = whole["class_context"]
    assert own["class_annotations"] == ["@Deprecated"] and own["imports"] == ["jakarta.inject.Inject"]
    assert [(d["type"], d["name"]) for d in own["injected_dependencies"]] == [("Store", "store")] and [f["name"] for f in own["fields"]] == ["store", "total"]
    assert next(m for m in whole["methods"] if m["name"] == "price")["internal_calls"] == ["add"]


def test_calls_are_looked_up_where_the_type_is(spark):
    import re

    from codeweft.plans.queries import QUERIES

    for name in ("ctx1_method_context", "ctx3_surgical_context"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"Exchange hashpartitioning\(fqn#\d+, (name|wanted)#\d+", plan)


def test_calls_are_in_their_order_with_all_methods_of_a_name(spark):
    from codeweft.graph import Graph
    from codeweft.operators import context as X

    nodes = spark.createDataFrame([("class:a.A", "CLASS", "a.A", "A", False, 1, "PENDING")], "id string, kind string, fqn string, simple_name string, external boolean, community_id long, status string")
    methods = spark.createDataFrame([("a.A", "f", "f()", "int", "{}", ["h", None, "g", "none", "g"]), ("a.A", "g", "g(x)", "int", None, None), ("a.A", "g", "g()", None, "{}", []), ("a.A", "h", "h()", "long", "{}", ["f"]), ("a.A", None, "n()", "long", "{}", ["f"])], "fqn string, name string, signature string, return_type string, raw_body string, calls array<string>")
    edges = spark.createDataFrame([], "type string, from_id string, to_id string, weight double, provenance string, confidence_score double")
    asked = spark.createDataFrame([("a.A", s) for s in ("f()", "g(x)", "h()")], "fqn string, wanted string")
    found = {r["wanted"]: r["context"] for r in X.method_contexts(Graph(nodes, edges, methods), asked).collect()}
    g = '{"n":"g","sig":"g()"},{"n":"g","sig":"g(x)","rt":"int"}'
    assert '"calls":[{"n":"h","sig":"h()","rt":"long"},%s,%s]' % (g, g) in found["f()"] and '"calls":[]' in found["g(x)"] and '"calls":[{"n":"f","sig":"f()","rt":"int"}]' in found["h()"]
