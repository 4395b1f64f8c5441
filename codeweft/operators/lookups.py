"""Point lookups, name resolution and predicates over nested type records."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import annotation_name, endpoint_class, simple_name
from ..graph import Graph
from ..storage import pinned

#: Marks of session beans and of injected fields (fixed values).
EJB_MARKS = ("@Stateless", "@Stateful", "@Singleton", "@MessageDriven")
INJECTION_MARKS = ("Inject", "EJB", "PersistenceContext", "Resource", "Autowired")


def find_type(graph: Graph, fqn: str) -> DataFrame:
    return graph.nodes.where(F.col("id") == f"class:{fqn}")


def exists(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, found) for every requested id."""
    return ids.join(nodes.select("id", F.lit(True).alias("hit")), "id", "left").select("id", F.coalesce("hit", F.lit(False)).alias("found"))


def attributes(graph: Graph, fqns: DataFrame, columns: list[str]) -> DataFrame:
    """Node attributes of requested FQNs; nulls where there is none."""
    return fqns.join(graph.nodes.where(F.col("id").startswith("class:")).select("fqn", *columns), "fqn", "left")


def community_members(graph: Graph, community: int) -> DataFrame:
    return graph.nodes.where(F.col("id").startswith("class:") & (F.col("community_id") == community)).select("fqn").orderBy("fqn")


def cluster_json(graph: Graph) -> DataFrame:
    """(community_id, json): members by FQN with kind, status and sorted method signatures."""
    methods = graph.methods.groupBy("fqn").agg(F.sort_array(F.collect_list("signature")).alias("methods"))
    members = graph.nodes.where(F.col("id").startswith("class:") & F.col("community_id").isNotNull()).join(methods, "fqn", "left")
    one = F.struct("fqn", F.col("simple_name").alias("simpleName"), "kind", "status", F.coalesce("methods", F.array().cast("array<string>")).alias("methods"))
    return members.groupBy("community_id").agg(F.to_json(F.sort_array(F.collect_list(one))).alias("json"))


def method_context(graph: Graph, requests: DataFrame) -> DataFrame:
    """(fqn, wanted) to the method with that signature, else the first of that name, with its type's attributes."""
    hits = requests.join(graph.methods, "fqn").where((F.col("signature") == F.col("wanted")) | (F.col("name") == F.col("wanted")))
    best = Window.partitionBy("fqn", "wanted").orderBy((F.col("signature") != F.col("wanted")).cast("int"), "signature")
    first = hits.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")
    return first.join(graph.nodes.where(F.col("id").startswith("class:")).select("fqn", "simple_name", "kind", "status"), "fqn", "left")


def call_signatures(graph: Graph, requests: DataFrame) -> DataFrame:
    """(fqn, calls array) to (fqn, pos, name, signature) in the order of the calls."""
    asked = requests.select("fqn", F.posexplode("calls").alias("pos", "name"))
    return asked.join(graph.methods.select("fqn", "name", "signature"), ["fqn", "name"]).select("fqn", "pos", "name", "signature")


def resolve_names(graph: Graph, queries: DataFrame) -> DataFrame:
    """(q, fqn): a type whose FQN is q or ends with ``.q``, the first in FQN order; null if none.

    All three ways to match make q the last segments of the FQN, so one equi-join on suffixes finds them.
    """
    parts = F.split("fqn", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, -i, i), "."))
    named = graph.classes().select("fqn", F.explode(suffixes).alias("q"))
    return queries.join(named, "q", "left").groupBy("q").agg(F.min("fqn").alias("fqn"))


def _grams(text: Column, n: int) -> Column:
    """All stretches of ``n`` characters, repeats included."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) if n else F.array(F.lit(""))


def seeds_by_name(names: DataFrame, questions: DataFrame, limit: int = 3, gram: int = 8) -> DataFrame:
    """(question_id, name, rank): names that the lower-cased question contains, the first ``limit`` in order.

    Of every name the stretch of ``gram`` characters (all of a shorter name) that the fewest names share stands
    for it; the questions' stretches meet these by an equi-join, and only names so met are looked for in full.
    """
    low = names.select("name", F.lower("name").alias("_low")).where(F.col("_low").isNotNull())
    lengths = sorted(r[0] for r in low.select(F.least(F.lit(gram), F.length("_low"))).distinct().collect())  # gram + 1 values at most
    of_length = [low.select("_low").distinct().where((F.length("_low") == n) if n < gram else (F.length("_low") >= n)).select("_low", F.explode(F.array_distinct(_grams(F.col("_low"), n))).alias("_gram")) for n in lengths]
    if not of_length:
        return questions.select("question_id", F.lit("").alias("name"), F.lit(0).alias("rank")).limit(0)
    parts = of_length[0]
    for more in of_length[1:]:
        parts = parts.union(more)
    shared = parts.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    rarest = parts.join(shared, "_gram").groupBy("_low").agg(F.min_by("_gram", F.struct("_n", "_gram")).alias("_gram"))
    rarest = pinned(rarest, "rarest-grams")
    few = rarest.count() <= 100_000  # then they may go to every task, else both sides are sorted
    asked = questions.select("question_id", F.lower("question").alias("_question"))
    every = F.array_distinct(F.concat(*[_grams(F.col("_question"), n) for n in lengths]))
    grams = asked.select("question_id", F.explode(every).alias("_gram"))
    met = (grams.join(F.broadcast(rarest), "_gram") if few else grams.hint("merge").join(rarest, "_gram")).select("question_id", "_low").distinct()
    hits = met.join(asked, "question_id").where(F.contains("_question", "_low")).select("question_id", "_low").join(low, "_low")
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy("name"))
    return hits.select("question_id", "name", rank.alias("rank")).where(F.col("rank") <= limit)


def deprecated_imports(types: DataFrame, prefix: str = "javax.") -> DataFrame:
    return types.select("file_path", F.explode("imports").alias("import_value"), "fqn").where(F.col("import_value").startswith(prefix))


def ejb_boundaries(types: DataFrame) -> DataFrame:
    return types.where(F.exists("annotations", lambda a: F.rlike(a, F.lit("|".join(EJB_MARKS)))))


def all_annotations(types: DataFrame) -> Column:
    """Annotation texts of a type, its methods, parameters, fields, enum constants and record components."""

    def of(column: str) -> Column:
        return F.flatten(F.transform(column, lambda x: x["annotations"]))

    parameters = F.flatten(F.transform("methods", lambda m: F.flatten(F.transform(m["parameters"], lambda p: p["annotations"]))))
    return F.concat("annotations", of("methods"), parameters, of("fields"), of("enum_constants"), of("record_components"))


def annotation_total(types: DataFrame) -> DataFrame:
    return types.select("fqn", F.size(all_annotations(types)).alias("annotations"))


def rule_hits(types: DataFrame, rules: DataFrame) -> DataFrame:
    """(fqn, rule id, name, category): types with an annotation, import prefix, superclass or interface of the rule.

    Rules are unfolded into keys, so annotations, superclasses and interfaces are equi-joins; only the
    prefixes, a constant of the rule set, are compared one by one.
    """
    m = F.col("match")
    texts = types.select("fqn", F.explode(F.array_distinct(all_annotations(types))).alias("text"))
    named = texts.select("fqn", F.explode(F.array_distinct(F.array("text", annotation_name(F.col("text"))))).alias("key"))
    wanted = rules.select("id", F.explode(m["annotations"]).alias("rule_text")).select("id", F.explode(F.array_distinct(F.array("rule_text", simple_name(F.col("rule_text"))))).alias("key"))
    hits = named.join(wanted, "key").select("fqn", "id")
    supers = types.select("fqn", F.explode(F.array_compact(F.concat(F.array("super_class"), "interfaces"))).alias("key"))
    parents = rules.select("id", F.explode(F.concat(m["superClasses"], m["interfaces"])).alias("key"))
    hits = hits.union(supers.join(parents, "key").select("fqn", "id"))
    imports = types.select("fqn", F.explode("imports").alias("name"))
    prefixes = rules.select("id", F.explode(m["importPrefixes"]).alias("prefix"))
    hits = hits.union(imports.join(prefixes, F.startswith("name", "prefix")).select("fqn", "id")).distinct()
    return hits.join(rules.select("id", "name", "category"), "id").select("fqn", "id", "name", "category")


def custom_hits(types: DataFrame, rule: tuple[str, str, str], matches: Callable[[pd.DataFrame], pd.Series], columns: list[str]) -> DataFrame:
    """(fqn, id, name, category) where a user's rule matches: it sees batches of ``columns`` and gives booleans."""

    def run(batches):
        for batch in batches:
            hits = batch.loc[matches(batch).to_numpy(bool), ["fqn"]]
            yield hits.assign(id=rule[0], name=rule[1], category=rule[2])

    return types.select("fqn", *columns).mapInPandas(run, "fqn string, id string, name string, category string")


def injected_fields(types: DataFrame) -> DataFrame:
    fields = F.filter("fields", lambda f: F.exists(f["annotations"], lambda a: F.rlike(a, F.lit("|".join(INJECTION_MARKS)))))
    return types.select("fqn", F.explode(fields).alias("field")).select("fqn", "field.type", "field.name")


def whitelisted(edges: DataFrame, types) -> DataFrame:
    """Edges of ``types`` with both ends as class FQNs."""
    return edges.where(F.col("type").isin(*types)).select("type", endpoint_class(F.col("from_id")).alias("a"), endpoint_class(F.col("to_id")).alias("b"), "weight").where("a IS NOT NULL AND b IS NOT NULL")
