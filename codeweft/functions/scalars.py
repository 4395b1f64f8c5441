"""Scalar functions of the graph as Column expressions; all stay inside generated code or SQL functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import EXTENSIONS

#: Colours of communities, in order (fixed values).
PALETTE = ("#4e79a7", "#f28e2b", "#e15759", "#76b7b2", "#59a14f", "#edc948", "#b07aa1", "#ff9da7")
#: Simple names that resolve to java.lang (fixed values).
JAVA_LANG = (
    "Boolean", "Byte", "Character", "Class", "Comparable", "Double", "Enum", "Error", "Exception", "Float", "IllegalArgumentException", "IllegalStateException",
    "Integer", "Iterable", "Long", "Math", "Number", "Object", "Override", "Runnable", "RuntimeException", "Short", "String", "StringBuilder", "System", "Thread", "Throwable", "Void",
)


def class_id(fqn: Column) -> Column:
    return F.concat(F.lit("class:"), fqn)


def method_id(fqn: Column, signature: Column) -> Column:
    return F.concat(F.lit("method:"), fqn, F.lit("#"), signature)


def tech_id(name: Column) -> Column:
    return F.concat(F.lit("tech:"), name)


def _body(node_id: Column) -> Column:
    """Without its kind. Every edge's ends pass here, several times over in a plan: plain prefixes, since a pattern costs far more."""
    kinds = [F.when(F.startswith(node_id, F.lit(k)), F.substr(node_id, F.lit(len(k) + 1))) for k in ("class:", "method:", "tech:")]
    return F.coalesce(*kinds, node_id)


def _owner(body: Column) -> Column:
    return F.when(F.instr(body, "#") > 1, F.substring_index(body, "#", 1)).otherwise(body)


def class_fqn_from_method_id(node_id: Column) -> Column:
    """Text before the first ``#``; the whole body if there is none or nothing before it."""
    return _owner(_body(node_id))


def signature_from_method_id(node_id: Column) -> Column:
    body = _body(node_id)
    return F.when(F.instr(body, "#") > 1, F.substr(body, F.instr(body, "#") + F.lit(1))).otherwise("")


def endpoint_class(node_id: Column) -> Column:
    """FQN of a class id, owning FQN of a method id, else null."""
    is_class, is_method = (F.startswith(node_id, F.lit(k)) for k in ("class:", "method:"))
    return F.when(is_class, F.substr(node_id, F.lit(7))).when(is_method, _owner(F.substr(node_id, F.lit(8))))


def simple_name(fqn: Column) -> Column:
    return F.substring_index(fqn, ".", -1)


def package_of(fqn: Column) -> Column:
    return F.when(F.contains(fqn, F.lit(".")), F.regexp_replace(fqn, r"\.[^.]*$", "")).otherwise("default")


def annotation_name(text: Column) -> Column:
    """Trimmed, without ``@`` and arguments, last segment."""
    return simple_name(F.trim(F.substring_index(F.regexp_replace(F.trim(text), "^@", ""), "(", 1)))


def build_fqn(package: Column, enclosing: Column, name: Column) -> Column:
    parts = F.concat(F.array(package), enclosing, F.array(name))
    return F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), ".")


def resolve_fqn(name: Column, package: Column, imports: Column) -> Column:
    """Explicit import, java.lang, first wildcard import, own package, bare; dotted names stay."""
    explicit = F.filter(imports, lambda i: ~i["is_static"] & ~i["is_wildcard"] & (simple_name(i["name"]) == name))
    wild = F.filter(imports, lambda i: ~i["is_static"] & i["is_wildcard"])
    return (
        F.when(F.contains(name, F.lit(".")), name)
        .when(F.size(explicit) > 0, F.try_element_at(explicit, F.lit(1))["name"])
        .when(name.isin(*JAVA_LANG), F.concat(F.lit("java.lang."), name))
        .when(F.size(wild) > 0, F.concat(F.regexp_replace(F.try_element_at(wild, F.lit(1))["name"], r"\.\*$", ""), F.lit("."), name))
        .when(F.coalesce(package, F.lit("")) != "", F.concat(package, F.lit("."), name))
        .otherwise(name)
    )


def token_estimate(text: Column) -> Column:
    """0 for blank text, else at least 1: a quarter of the length."""
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", 0).otherwise(F.greatest(F.lit(1), F.floor(F.length(text) / 4))).cast("long")


def cosine(a: Column, b: Column) -> Column:
    """0 for null, empty or zero vectors; an error for different lengths; products in float, sums in double."""

    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: (p.cast("float") * q.cast("float")).cast("double")), F.lit(0.0), lambda s, v: s + v)

    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    empty = a.isNull() | b.isNull() | (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(empty, 0.0).when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in length")).cast("double")).when(size == 0, 0.0).otherwise(dot(a, b) / size)


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def escape_quotes(text: Column) -> Column:
    """For JavaScript and Cypher literals."""
    return F.replace(text, F.lit("'"), F.lit("\\'"))


def escape_xml(text: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text


def tech_slug(category: Column) -> Column:
    return F.concat(F.lit("tech-"), F.replace(F.lower(category), F.lit(" "), F.lit("-")))


def provenance(text: Column) -> Column:
    return F.upper(F.coalesce(F.nullif(F.trim(text), F.lit("")), F.lit("EXTRACTED")))


def language_of(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(F.substring_index(path, ".", -1))), F.raise_error(F.concat(F.lit("unknown language: "), path)).cast("string"))


def community_colour(community: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in PALETTE]), (F.pmod(F.coalesce(community, F.lit(0)), F.lit(len(PALETTE))) + 1).cast("int"))
