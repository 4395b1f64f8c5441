"""Repair of conversation structure by A* on the edit lattice.

The rows of a conversation are kept (free), given another role (2) or deleted (3, required for blank and
duplicate rows), and turns of empty text may be put in (2), so that the roles read as an optional system
turn and then pairs of user and assistant. A row cut short that stays costs 1 more. The lattice has a node for each
row and state of that pattern. A* searches it with the suffix sum of what no repair can avoid as its
heuristic: 3 for each row that must go and 1 for each row cut short, which costs 1 if it stays and 3 if not. The queue is
keyed (cost plus heuristic, audit), where the audit is the string of the edits' initials, so that of the
cheapest repairs the one with the least audit is settled first.

How it runs: a first pass reads the texts and keeps only a digest, the role's initial and the faults of each
row. Equal rows are counted, which finds duplicates by a grouping and a join without a conversation in one
place. Rows are then sorted by conversation and turn over range partitions, which split a conversation
wherever it is long, and cut into segments of at most ``SEGMENT`` rows. A* settles each segment from every
state in which it can be entered (one, where a conversation is seen to begin) to every state in which it can
be left: a table of cost and audit, four by four at most. Tables of a conversation are folded in order; only four audits are in memory. A last pass
sends the texts once, in order behind their conversation's audit, and hashes the repaired rows as they
stream by (a hash reads its bytes in order, so one conversation's bytes pass one task, never held there).

Results for odd input: null roles, texts, turns and ids are read as one space where text is needed; null turns come first
and count in no gap; a null id is a conversation; rows of one turn go by role and digest of the text, copies
side by side; empty and blank texts are faults by definition; long texts and conversations are taken whole; a conversation
that has no rows left has an empty repair; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, pinned, table

SEGMENT = 256
RENAME, DELETE, INSERT, CUT = 2, 3, 2, 1
NAMES = {"u": "user", "a": "assistant"}
#: The pattern (s?(ua)+)? as states: nothing yet, after s, after u, after a. What may follow in each:
FOLLOW = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
STATES, ENDS = range(4), (0, 3)
#: Pairs of roles that may stand side by side.
LEGAL = ("su", "ua", "au")
FIELDS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _spaced(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def damage(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text after a fixed damage: by crc32 of ``id:turn`` modulo 20, rows are dropped, emptied, stripped of sentence ends, repeated or given to the user."""
    fate = F.crc32(F.concat(_spaced(F.col(id_col)), F.lit(":"), _spaced(F.col(turn_col))).cast("binary")) % 20
    text, role = _spaced(F.col(text_col)), _spaced(F.col(role_col))
    hurt = F.when(fate == 1, F.lit("")).when(fate == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.explode(F.array_repeat(F.lit(0), F.when(fate == 3, 2).otherwise(1)))
    out = rows.where(fate != 0).select(F.col(id_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.when(fate == 4, F.lit("user")).otherwise(role).alias("role"), hurt.alias("text"), copies.alias("_copy"))
    return out.drop("_copy")


def _digest() -> Column:
    """128 bits of a hash of role and text."""
    return F.substring(F.unhex(F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text").cast("binary"), 256)), 1, 16)


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, copy, initial, fault of each row: b(lank), d(uplicate), t(runcated) or empty; no texts."""
    end = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    own = F.when(~F.col("text").rlike(WORD), "b").when(~end.rlike("[.!?]"), "t").otherwise("")
    light = rows.select("conv_id", "turn", "role", _digest().alias("digest"), F.substring("role", 1, 1).alias("initial"), own.alias("own"))
    counted = light.groupBy("conv_id", "turn", "role", "digest", "initial", "own").agg(F.count(F.lit(1)).alias("n"))
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    firsts = counted.groupBy("conv_id", "digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("turns")).where("turns > 1").select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), "first")
    joined = counted.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left")
    later = F.col("first").isNotNull() & (place > F.col("first"))
    each = joined.withColumn("later", later).select("*", F.explode(F.sequence(F.lit(1), "n")).alias("copy"))
    fault = F.when(F.col("own") == "b", "b").when(F.col("later") | (F.col("copy") > 1), "d").otherwise(F.col("own"))
    return each.select("conv_id", "turn", "role", "digest", "copy", "initial", fault.alias("fault"))


def settle(initials: list[str], faults_: list[str], entry: int) -> dict[int, tuple[int, str]]:
    """The cheapest way from ``entry`` through all rows to each state: cost and least audit, by A*."""
    n = len(initials)
    ahead = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        ahead[i] = ahead[i + 1] + (DELETE if faults_[i] in ("b", "d") else CUT if faults_[i] == "t" else 0)
    queue, done, ends = [(ahead[0], "", 0, entry)], set(), {}
    while queue and len(ends) < len(STATES):
        key, audit, i, state = heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n:
            ends[state] = (key, audit)
        else:
            cost = key - ahead[i] + ahead[i + 1]
            heappush(queue, (cost + DELETE, audit + "D", i + 1, state))
            if faults_[i] not in ("b", "d"):
                stay = cost + (CUT if faults_[i] == "t" else 0)
                for initial, to in FOLLOW[state].items():
                    if initials[i] == initial:
                        heappush(queue, (stay, audit + "K", i + 1, to))
                    if initial in NAMES:
                        heappush(queue, (stay + RENAME, audit + "R", i + 1, to))
        for initial, to in FOLLOW[state].items():
            if initial in NAMES:
                heappush(queue, (key + INSERT, audit + "I", i, to))
    return ends


def follow(left: dict[int, tuple[int, str]], right: dict[int, dict[int, tuple[int, str]]]) -> dict[int, tuple[int, str]]:
    """Ways to each state through one segment more."""
    out: dict[int, tuple[int, str]] = {}
    for middle, (cost, audit) in left.items():
        for to, (more, edits) in right.get(middle, {}).items():
            way = (cost + more, audit + edits)
            if to not in out or way < out[to]:
                out[to] = way
    return out


SEGMENTS = "part int, segment long, first_turn long, last_turn long, turns long, first string, last string, rows long, blank long, duplicate long, truncated long, illegal long, tables array<struct<entry: int, exit: int, cost: long, audit: string>>"


def segments(rows: DataFrame, most: int = SEGMENT) -> DataFrame:
    """A row for each stretch of at most ``most`` rows of a conversation: its counts, its ends and its table of ways."""
    from pyspark.sql.types import StructType

    order = ["conv_id", F.asc_nulls_first("turn"), "role", "digest", "copy"]
    # A repartition by range samples the rows' keys, so that hot conversations are spread.
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "initial", "fault")
    schema = StructType([rows.schema["conv_id"], *StructType.fromDDL(SEGMENTS)])

    def of(begins: bool, part: int, number: int, conv, turns: list, initials: list[str], faults_: list[str]) -> tuple:
        known = [t for t in turns if t is not None]
        tables = [(entry, to, cost, audit) for entry in ((0,) if begins else STATES) for to, (cost, audit) in settle(initials, faults_, entry).items()]
        illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
        first, last = (known[0], known[-1]) if known else (None, None)
        return conv, part, number, first, last, len(set(known)), initials[0], initials[-1], len(turns), faults_.count("b"), faults_.count("d"), faults_.count("t"), illegal, tables

    def run(batches):
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, part, number = to_arrow_schema(schema), TaskContext.get().partitionId(), 0
        made, held = [], ([], [], [])
        conv, begins = None, False  # a partition's first rows may go on from the one before
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "fault")]
            for c, *row in zip(*columns):
                if held[0] and (c != conv or len(held[0]) >= most):
                    made.append(of(begins, part, number, conv, *held))
                    number, held, begins = number + 1, ([], [], []), c != conv
                conv = c
                for values, value in zip(held, row):
                    values.append(value)
            if len(made) >= 2000:
                yield _batch(made, arrow)
                made = []
        if held[0]:
            made.append(of(begins, part, number, conv, *held))
        yield _batch(made, arrow)

    return dealt.mapInArrow(run, schema)


def _batch(rows: list[tuple], arrow):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([_named(r[i]) if f.name == "tables" else r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)


def _named(tables: list[tuple]) -> list[dict]:
    return [dict(zip(("entry", "exit", "cost", "audit"), t)) for t in tables]


def _fold(parts: Iterator[dict]) -> dict | None:
    """Counts and the cheapest way through all segments of one conversation, in order."""
    ways, out, last, first_turn, last_turn, distinct = {0: (0, "")}, dict.fromkeys(FIELDS, 0), None, None, None, 0
    for s in parts:
        right: dict[int, dict[int, tuple[int, str]]] = {}
        for t in s["tables"]:
            right.setdefault(t["entry"], {})[t["exit"]] = (t["cost"], t["audit"])
        ways = follow(ways, right)
        for name in ("blank", "duplicate", "truncated", "illegal"):
            out[name] += s[name]
        if last is not None and last + s["first"] not in LEGAL:
            out["illegal"] += 1
        last = s["last"]
        if s["first_turn"] is not None:
            distinct += s["turns"] - (last_turn == s["first_turn"])
            first_turn = s["first_turn"] if first_turn is None else first_turn
            last_turn = s["last_turn"]
    if first_turn is not None:
        out["gaps"] = last_turn - first_turn + 1 - distinct
    out["cost"], out["audit"] = min(ways[state] for state in ENDS if state in ways)
    return out


def audits(parts: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of each conversation that has rows."""
    from pyspark.sql.types import StructType

    schema = StructType([parts.schema["conv_id"], *StructType.fromDDL(", ".join(f"{c} long" for c in FIELDS) + ", audit string")])

    def run(batches):
        from itertools import groupby

        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        made = []
        rows = (row for batch in batches for row in batch.to_pylist())
        for conv, own in groupby(rows, key=lambda r: r["conv_id"]):
            found = _fold(own)
            made.append((conv, *(found[c] for c in FIELDS), found["audit"]))
            if len(made) >= 2000:
                yield _batch(made, arrow)
                made = []
        yield _batch(made, arrow)

    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "part", "segment").mapInArrow(run, schema)


class Repair:
    """Takes a conversation's rows in order and applies its audit; ``text`` gives the repaired rows, newline-joined, bit by bit."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.started = audit, 0, 0, False

    def _put(self, role: str | None, text: str) -> str:
        if role is None:
            initial = next(i for i in FOLLOW[self.state] if i in NAMES)
            role = NAMES[initial]
        self.state = FOLLOW[self.state][role[:1]]
        joint, self.started = "\n" if self.started else "", True
        return f"{joint}{role}:{text}"

    def inserted(self) -> str:
        out = ""
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            out += self._put(None, "")
        return out

    def row(self, role: str, text: str) -> str:
        out = self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        return out if edit == "D" else out + self._put(role if edit == "K" else None, text)


def repaired(rows: DataFrame, found: DataFrame, ids: DataFrame) -> DataFrame:
    """``found`` with repaired_sha256, and a row of zeros for each id of ``ids`` that has no rows."""
    from pyspark.sql.types import StructType

    null = lambda kind: F.lit(None).cast(kind)
    counts = [F.col(c) for c in FIELDS]
    no_counts = [null("long").alias(c) for c in FIELDS]
    # Kinds: 0 an id, 1 what was found of it, 2 its rows.
    known = ids.select("conv_id", F.lit(0).alias("kind"), null("long").alias("turn"), null("string").alias("role"), null("string").alias("text"), null("binary").alias("digest"), *no_counts)
    told = found.select("conv_id", F.lit(1), null("long"), null("string"), F.col("audit"), null("binary"), *counts)
    texts = rows.select("conv_id", F.lit(2), "turn", "role", "text", _digest(), *no_counts)
    order = ["conv_id", "kind", F.asc_nulls_first("turn"), "role", "digest"]
    dealt = known.union(told).union(texts).repartition("conv_id").sortWithinPartitions(*order)
    schema = StructType([found.schema["conv_id"], *StructType.fromDDL(", ".join(f"{c} long" for c in FIELDS) + ", audit string, repaired_sha256 string")])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        made, open_ = [], None

        def close():
            conv, values, repair, digest = open_
            digest.update(repair.inserted().encode())
            made.append((conv, *values, repair.audit, digest.hexdigest()))

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in batch.schema.names]
            for conv, kind, _, role, text, _, *values in zip(*columns):
                if kind == 0:
                    if open_:
                        close()
                    open_ = (conv, [0] * len(FIELDS), Repair(""), hashlib.sha256())
                elif kind == 1:
                    open_ = (conv, values, Repair(text), open_[3])
                else:
                    open_[3].update(open_[2].row(role, text).encode())
            yield _batch(made, arrow)
            made.clear()
        if open_:
            close()
        yield _batch(made, arrow)

    return dealt.mapInArrow(run, schema)


def repair(rows: DataFrame, ids: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row for each of ``ids``: counts of faults, cost, audit and hash of the repair of ``rows`` (conv_id, turn, role, text without nulls but in ids and turns)."""
    found = pinned(audits(pinned(segments(pinned(faults(rows), "conversation-faults"), segment), "conversation-segments")), "conversation-audits")
    return repaired(rows, found, ids.select("conv_id").distinct()).select("conv_id", *FIELDS, "audit", "repaired_sha256")


def op12_conversations(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair(damage(rows), rows)
