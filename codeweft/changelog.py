"""A graph kept as a base and small batches of changes that are merged when it is read.

A folder holds tables under names that are never reused, and numbered commits. A commit lists the base and the
batches of changes of one version; the highest number is the current one. Commits are put in place by a
rename that fails if the number is taken, so readers see a version whole or not at all, and a reader of an
older version keeps it until retention removes it. A change is a whole row, or a tombstone for its key; the
last batch that names a key decides. A batch of events writes what the events touch, not the graph, and a
reader moves only the rows of the base that a change may name.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .graph import Graph
from .operators.sieve import sieve

GRAPH = ("nodes", "edges", "methods", "types")
KEYS = {
    "nodes": ["id"], "edges": ["type", "from_id", "to_id"], "methods": ["fqn", "signature"], "types": ["fqn"], "applied": ["kind", "node_id"], "embeddings": ["node_id"],
    "labels": ["community_id"], "hyperedges": ["id"], "members": ["hyperedge_id", "node_id"], "answers": ["id"], "answer_nodes": ["answer_id", "node_id"],
}


@dataclass(frozen=True)
class Commit:
    """base: a folder and the schemas of its tables; changes: the same, oldest first; batch: the last batch of a stream in it."""

    number: int
    base: dict
    changes: list[dict]
    batch: int = -1

    def folders(self) -> set[str]:
        return {x["folder"] for x in [self.base, *self.changes]}


class GraphLog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # ---- commits

    def numbers(self) -> list[int]:
        place = self._path(f"{self.root}/commits")
        if not self._fs.exists(place):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(place)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def commit(self, number: int | None = None) -> Commit:
        number = self.numbers()[-1] if number is None else number
        lines = self.spark.read.text(f"{self.root}/commits/{number}.json").collect()  # one line
        return Commit(**json.loads(lines[0][0]))

    def _put(self, commit: Commit) -> Commit:
        """Make ``commit`` the current one; an error if its number is taken."""
        temporary, place = (self._path(f"{self.root}/commits/{n}") for n in (f".{uuid.uuid4().hex}", f"{commit.number}.json"))
        out = self._fs.create(temporary, False)
        out.write(bytearray(json.dumps(commit.__dict__).encode()))
        out.close()
        if self._fs.exists(place) or not self._fs.rename(temporary, place):
            self._fs.delete(temporary, False)
            raise FileExistsError(f"version {commit.number} of {self.root} was made by another writer")
        return commit

    def _write(self, tables: dict[str, DataFrame]) -> dict:
        folder = f"data-{uuid.uuid4().hex}"
        for name, rows in tables.items():
            writer = rows.write
            (writer.partitionBy("type") if name == "edges" else writer).parquet(f"{self.root}/{folder}/{name}")
        return {"folder": folder, "tables": {name: rows.schema.jsonValue() for name, rows in tables.items()}}

    # ---- versions

    def create(self, graph: Graph | None = None, **tables: DataFrame) -> Commit:
        """A version of a graph and other tables of ``KEYS``."""
        tables |= {n: getattr(graph, n) for n in GRAPH if graph is not None and getattr(graph, n) is not None}
        return self._put(Commit((self.numbers() or [-1])[-1] + 1, self._write(tables), []))

    def append(self, changes: dict[str, DataFrame], batch: int = -1) -> Commit:
        """A version with ``changes``: rows with a column ``gone``, true for tombstones, each key once. A batch that is in already changes nothing."""
        now = self.commit()
        if 0 <= batch <= now.batch:
            return now
        return self._put(Commit(now.number + 1, now.base, [*now.changes, self._write(changes)], max(batch, now.batch)))

    def _table(self, commit: Commit, name: str) -> DataFrame | None:
        def load(part: dict) -> DataFrame:
            # The schema is kept, since an empty partitioned table has no file that tells it.
            schema = StructType.fromJson(part["tables"][name])
            return self.spark.read.schema(schema).parquet(f"{self.root}/{part['folder']}/{name}").select(*schema.names)

        base = load(commit.base) if name in commit.base["tables"] else None
        parts = [load(c).withColumn("_at", F.lit(i)) for i, c in enumerate(commit.changes) if name in c["tables"]]
        if not parts:
            return base
        key = KEYS[name]
        changed = reduce(DataFrame.unionByName, parts)
        rest = [c for c in changed.columns if c not in key]
        # A batch names a key once, so only several batches have to be compared.
        last = changed if len(parts) == 1 else changed.groupBy(*key).agg(F.max_by(F.struct(*rest), "_at").alias("_last")).select(*key, "_last.*")
        kept = last.where(~F.col("gone")).drop("gone", "_at")
        if base is None:
            return kept
        # Most rows of the base stay where they are: edges of types that did not change, and rows that no change can name.
        same, others = [], base
        if name == "edges":
            types = [r[0] for r in changed.select("type").distinct().collect()]  # a handful
            of = F.coalesce(F.col("type").isin(types), F.lit(False))
            same, others = [base.where(~of)], base.where(of)
        looked = sieve(changed, *key).marked(others, "_maybe", *key)
        found = looked.where("_maybe").join(last.select(*key), key, "left_anti")
        return reduce(DataFrame.unionByName, [x.select(*base.columns) for x in (*same, looked.where("not _maybe"), found, kept)])

    def graph(self, number: int | None = None) -> Graph:
        """A version, the current one by default, its changes merged in."""
        commit = self.commit(number)
        return Graph(**{n: self._table(commit, n) for n in GRAPH})

    def table(self, name: str, number: int | None = None) -> DataFrame | None:
        """Any table of a version; None if it never had it."""
        return self._table(self.commit(number), name)

    def upsert(self, name: str, rows: DataFrame) -> Commit:
        """Rows that replace those of their key."""
        return self.append({name: rows.withColumn("gone", F.lit(False))})

    def applied(self) -> DataFrame:
        """(kind, node_id, timestamp): the last event of each kind and node that was applied."""
        found = self._table(self.commit(), "applied")
        return self.spark.createDataFrame([], "kind string, node_id string, timestamp timestamp") if found is None else found

    def compact(self) -> Commit:
        """A version of the same rows whose base holds all changes."""
        now = self.commit()
        tables = {n: t for n in KEYS if (t := self._table(now, n)) is not None}
        return self._put(Commit(now.number + 1, self._write(tables), [], now.batch))

    def truncate(self) -> Commit:
        """An empty version; those before it stay readable."""
        now = self.commit()
        tables = {n: t.limit(0) for n in KEYS if n != "applied" and (t := self._table(now, n)) is not None}
        return self._put(Commit(now.number + 1, self._write(tables), [], now.batch))

    def retain(self, keep: int = 2) -> list[str]:
        """Remove all but the last ``keep`` versions, and the folders that only those removed need; gives the folders."""
        numbers = self.numbers()
        old, kept = numbers[:-keep], numbers[-keep:]
        needed = set().union(*(self.commit(n).folders() for n in kept)) if kept else set()
        gone = sorted(set().union(*(self.commit(n).folders() for n in old)) - needed) if old else []
        for n in old:  # commits first, so that no version lists a folder that is gone
            self._fs.delete(self._path(f"{self.root}/commits/{n}.json"), False)
        for folder in gone:
            self._fs.delete(self._path(f"{self.root}/{folder}"), True)
        return gone


def difference(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``after`` that ``before`` has not, and tombstones for keys that are gone; keys are unique on either side."""
    columns = before.columns
    rest = [c for c in columns if c not in key]
    maps = [f.name for f in before.schema if "map<" in f.dataType.simpleString()]  # have no equality but as text

    def side(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(*key, F.struct(F.lit(True).alias("_is"), *rest).alias(name))

    def value(side: str, column: str):
        return F.to_json(F.struct(f"{side}.{column}")) if column in maps else F.col(f"{side}.{column}")

    both = side(before, "_old").join(side(after, "_new"), key, "full_outer")
    same = reduce(Column.__and__, [value("_old", c).eqNullSafe(value("_new", c)) for c in ["_is", *rest]])
    row = F.coalesce("_new", "_old")
    return both.where(~same).select(*[F.col(c) if c in key else row[c].alias(c) for c in columns], F.col("_new").isNull().alias("gone"))
