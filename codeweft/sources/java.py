"""Types of Java source files. A small scanner reads declarations; resolving and joining names is Spark's work."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalars import resolve_fqn
from ..schemas import TYPES

BACKENDS = ("jparser", "treesitter")
_TOKEN = re.compile(r"//[^\n]*|/\*.*?\*/|\"\"\".*?\"\"\"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|[A-Za-z_$][\w$]*|\d[\w.]*|::|->|\.\.\.|\S", re.S)
_MODIFIERS = frozenset("public protected private static final abstract native synchronized transient volatile strictfp default sealed".split())
_NOT_CALLS = frozenset("if for while switch catch return synchronized super this new throw try do else assert yield when case".split())
_KINDS = {"class": "CLASS", "interface": "INTERFACE", "enum": "ENUM", "record": "RECORD"}
_OPEN, _CLOSE = {"(": ")", "{": "}", "[": "]", "<": ">"}, frozenset(")}]>")


def backend(value: str | None) -> str:
    """The parser's profile by name; blank is the default."""
    name = (value or "").strip().lower() or BACKENDS[0]
    if name not in BACKENDS:
        raise ValueError(f"unknown parser backend: {value}")
    return name


class _Scanner:
    def __init__(self, source: str):
        self.source = source
        self.t = [(m.group(), m.start(), m.end()) for m in _TOKEN.finditer(source) if not m.group().startswith(("//", "/*"))]
        self.i, self.types = 0, []

    def at(self, n: int = 0) -> str:
        return self.t[self.i + n][0] if self.i + n < len(self.t) else ""

    def text(self, a: int, b: int) -> str:
        return self.source[self.t[a][1] : self.t[b - 1][2]] if b > a else ""

    def skip(self) -> tuple[int, int]:
        """Past a bracket and what it encloses; gives the tokens' range inside."""
        start, close, depth = self.i, _OPEN[self.at()], 0
        own = self.at()
        while self.i < len(self.t):
            depth += (self.at() == own) - (self.at() == close)
            self.i += 1
            if not depth:
                break
        return start + 1, self.i - 1

    def until(self, *stops: str) -> tuple[int, int]:
        start = self.i
        while self.i < len(self.t) and self.at() not in stops:
            if self.at() in "({[" and self.at():
                self.skip()
            else:
                self.i += 1
        return start, self.i

    def name(self) -> str:
        start = self.i
        self.i += 1
        while self.at() == "." and re.match(r"[\w$]", self.at(1)):
            self.i += 2
        return "".join(x[0] for x in self.t[start : self.i])

    def type_name(self) -> str:
        start = self.i
        while self.at() == "@":
            self.annotation()
        self.name()
        while self.at() in ("<", "[", "...", ".") and self.i < len(self.t):
            if self.at() in ("<", "["):
                self.skip()
            else:
                self.i += 1 if self.at() == "..." else 2
        return re.sub(r"\s+", " ", self.text(start, self.i))

    def annotation(self) -> str:
        start = self.i
        self.i += 1
        self.name()
        if self.at() == "(":
            self.skip()
        return re.sub(r"\s+", " ", self.text(start, self.i))

    def head(self) -> tuple[list[str], list[str]]:
        modifiers, annotations = [], []
        while True:
            if self.at() == "@" and self.at(1) != "interface":
                annotations.append(self.annotation())
            elif self.at() in _MODIFIERS and self.at(1) not in (":", "->"):
                modifiers.append(self.at())
                self.i += 1
            elif self.at() == "non" and self.at(1) == "-":
                self.i += 3
            else:
                return modifiers, annotations

    def split(self, a: int, b: int) -> list[str]:
        """Texts between commas at no depth."""
        out, depth, start = [], 0, a
        for j in range(a, b):
            tok = self.t[j][0]
            depth += (tok in _OPEN) - (tok in _CLOSE)
            if tok == "," and depth <= 0:
                out.append(self.text(start, j))
                start = j + 1
        return [re.sub(r"\s+", " ", x) for x in [*out, self.text(start, b)] if x.strip()]

    def is_type(self) -> bool:
        word = self.at()
        if word == "@" and self.at(1) == "interface":
            return True
        named = re.match(r"[A-Za-z_$]", self.at(1)) is not None
        return named and (word in ("class", "interface", "enum") or (word == "record" and self.at(2) in ("(", "<")))

    def file(self) -> list[dict]:
        package, imports = "", []
        while self.i < len(self.t):
            modifiers, annotations = self.head()
            if self.at() == "package":
                self.i += 1
                package = self.name()
            elif self.at() == "import":
                self.i += 1
                static = self.at() == "static"
                self.i += static
                name = self.name()
                wild = self.at() == "." and self.at(1) == "*"
                imports.append({"name": name, "is_static": static, "is_wildcard": wild})
                self.until(";")
            elif self.is_type():
                self.type(package, [], modifiers, annotations)
            else:
                self.i += 1
        for t in self.types:
            t["import_nodes"], t["imports"] = imports, [i["name"] for i in imports]
        return self.types

    def type(self, package: str, enclosing: list[str], modifiers: list[str], annotations: list[str]) -> None:
        kind = "ANNOTATION" if self.at() == "@" else _KINDS[self.at()]
        self.i += 2 if kind == "ANNOTATION" else 1
        simple = self.at()
        self.i += 1
        t = dict(package_name=package, simple_name=simple, fqn=".".join(x for x in [package, *enclosing, simple] if x), kind=kind, language="JAVA", modifiers=modifiers, annotations=annotations, type_parameters=[], super_class=None, interfaces=[], methods=[], fields=[], enum_constants=[], record_components=[], static_initializers=[], language_metadata={}, status="PENDING")
        self.types.append(t)
        if self.at() == "<":
            t["type_parameters"] = self.split(*self.skip())
        if self.at() == "(":
            t["record_components"] = [self.parameter(x) for x in self.split(*self.skip())]
        while self.at() in ("extends", "implements", "permits"):
            word = self.at()
            self.i += 1
            names = []
            while True:
                names.append(re.sub(r"<.*|@\S+\s", "", self.type_name()))
                if self.at() != ",":
                    break
                self.i += 1
            if word == "extends":
                t["super_class"] = names[0]
            elif word == "implements":
                t["interfaces"] = names
        if self.at() == "{":
            self.i += 1
            if kind == "ENUM":
                self.constants(t)
            self.members(t, package, [*enclosing, simple])

    def parameter(self, text: str) -> dict:
        annotations = re.findall(r"@[\w.]+(?:\([^)]*\))?", text)
        words = re.sub(r"@[\w.]+(?:\([^)]*\))?|\bfinal\b", " ", text).split()
        return {"type": " ".join(words[:-1]), "name": words[-1] if words else "", "annotations": annotations}

    def constants(self, t: dict) -> None:
        while self.i < len(self.t) and self.at() not in (";", "}"):
            _, annotations = self.head()
            name, arguments = self.at(), []
            self.i += 1
            if self.at() == "(":
                arguments = self.split(*self.skip())
            if self.at() == "{":
                self.skip()
            t["enum_constants"].append({"name": name, "arguments": arguments, "annotations": annotations})
            if self.at() == ",":
                self.i += 1

    def members(self, t: dict, package: str, enclosing: list[str]) -> None:
        constructors = []
        while self.i < len(self.t) and self.at() != "}":
            modifiers, annotations = self.head()
            if self.is_type():
                self.type(package, enclosing, modifiers, annotations)
            elif self.at() == "{":
                a, b = self.skip()
                if "static" in modifiers:
                    t["static_initializers"].append(self.text(a - 1, b + 1))
            elif not re.match(r"[\w$<]", self.at()):
                self.i += 1
            else:
                self.member(t, modifiers, annotations, constructors)
        self.i += 1
        t["methods"] += constructors

    def member(self, t: dict, modifiers: list[str], annotations: list[str], constructors: list[dict]) -> None:
        parameters = self.split(*self.skip()) if self.at() == "<" else []
        constructor = self.at() == t["simple_name"] and self.at(1) in ("(", "{")
        kind = "" if constructor else self.type_name()
        name = self.at()
        self.i += 1
        if self.at() != "(" and not constructor:
            while True:
                while self.at() == "[":
                    self.skip()
                value = None
                if self.at() == "=":
                    self.i += 1
                    value = self.text(*self.until(",", ";"))
                t["fields"].append({"type": kind, "name": name, "annotations": annotations, "value": value})
                if self.at() != ",":
                    break
                name = self.at(1)
                self.i += 2
            self.i += self.at() == ";"
            return
        arguments = [self.parameter(x) for x in self.split(*self.skip())] if self.at() == "(" else t["record_components"]
        thrown = []
        if self.at() == "throws":
            self.i += 1
            a, b = self.until("{", ";")
            thrown = self.split(a, b)
        body = (self.i, self.i)
        if self.at() == "{":
            a, b = self.skip()
            body = (a - 1, b + 1)
        else:
            self.until(";")
            self.i += 1
        words = [w[0] for w in self.t[body[0] : body[1]]]
        calls = [w for j, w in enumerate(words[:-1]) if words[j + 1] == "(" and re.match(r"[A-Za-z_$]", w) and w not in _NOT_CALLS and (j == 0 or words[j - 1] != "new")]
        signature = " ".join(x for x in [*modifiers, f"<{', '.join(parameters)}>" if parameters else "", kind, name + "(" + ", ".join(f"{p['type']} {p['name']}" for p in arguments) + ")", f"throws {', '.join(thrown)}" if thrown else ""] if x)
        text = self.text(*body)
        method = {"name": "<init>" if constructor else name, "signature": signature, "return_type": kind, "modifiers": modifiers, "annotations": annotations, "type_parameters": parameters, "parameters": arguments, "thrown_exceptions": thrown, "constructor": constructor, "raw_body": text, "internal_method_calls": calls, "method_references": re.findall(r"[\w.$]+::\w+", text)}
        if t["kind"] != "ANNOTATION":
            (constructors if constructor else t["methods"]).append(method)


def _treesitter(t: dict) -> dict:
    """The profile of the other backend: it knows no type parameters, throws, references or initializers."""
    methods = [m | {"type_parameters": [], "thrown_exceptions": [], "method_references": []} for m in t["methods"]]
    return t | {"type_parameters": [], "static_initializers": [], "methods": methods, "super_class": None if t["kind"] == "INTERFACE" else t["super_class"]}


def parse_source(source: str, profile: str = BACKENDS[0]) -> list[dict]:
    types = _Scanner(source).file()
    return [_treesitter(t) for t in types] if profile == "treesitter" else types


def extract_types(files: DataFrame, profile: str | None = None, parse: Callable[[str, str], list[dict]] = parse_source) -> DataFrame:
    """Types of (path, source); superclasses and interfaces are resolved to FQNs. A file that fails gives no type.

    ``parse`` is the extension point for other languages.
    """
    chosen = backend(profile)
    names = StructType.fromDDL(TYPES).names

    def run(batches):
        for batch in batches:
            rows = []
            for path, source in zip(batch["path"], batch["source"]):
                try:
                    found = parse(source or "", chosen)
                except (IndexError, ValueError, RecursionError):
                    continue
                rows += [[(t | {"file_path": path})[n] for n in names] for t in found]
            yield pd.DataFrame(rows, columns=names)

    raw = files.select("path", "source").mapInPandas(run, TYPES)
    resolved = F.transform("interfaces", lambda i: resolve_fqn(i, F.col("package_name"), F.col("import_nodes")))
    parent = F.when(F.col("super_class").isNotNull(), resolve_fqn(F.col("super_class"), F.col("package_name"), F.col("import_nodes")))
    return raw.withColumns({"super_class": parent, "interfaces": resolved})


def parse_errors(files: DataFrame, types: DataFrame) -> DataFrame:
    """Files without any type."""
    return files.select("path").join(types.select(F.col("file_path").alias("path")), "path", "left_anti")
