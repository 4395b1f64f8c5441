"""Conversation repair against a plain table of all cheapest ways, and against trying every short audit."""

import collections
import hashlib
import itertools
import random
import re
import zlib

from codeweft.llm import conversations

WHITE = " \t\n\x0b\x0c\r"
PATTERN = re.compile(r"(s?(ua)+)?\Z")


def damaged(rows):
    """{conv: [(turn, role, text)] in order} of (conv, turn, role, text) rows."""
    out = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        spaced = [" " if x is None else str(x) for x in (conv, turn, role, text)]
        fate = zlib.crc32(f"{spaced[0]}:{spaced[1]}".encode()) % 20
        role, text = "user" if fate == 4 else spaced[2], "" if fate == 1 else re.sub("[.!?]", "", spaced[3]) if fate == 2 else spaced[3]
        out[conv] += [] if fate == 0 else [(turn, role, text)] * (2 if fate == 3 else 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0)) for c, v in out.items()}


def faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        body = text.strip(WHITE)
        out.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(initials, found):
    """(cost, audit) by filling in every place of the lattice."""
    follow = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}

    def with_inserts(best):
        for _ in range(8):
            for state, (cost, audit) in list(best.items()):
                for r, to in follow[state].items():
                    if r != "s":
                        best[to] = min(best.get(to, (1e9, "")), (cost + 2, audit + "I"))
        return best

    best = with_inserts({0: (0, "")})
    for initial, fault in zip(initials, found):
        new = {}
        for state, (cost, audit) in best.items():
            ways = [(state, 3, "D")]
            if fault not in ("b", "d"):
                more = 1 if fault == "t" else 0
                ways += [(to, more, "K") for r, to in follow[state].items() if r == initial]
                ways += [(to, more + 2, "R") for r, to in follow[state].items() if r != "s"]
            for to, c, e in ways:
                new[to] = min(new.get(to, (1e9, "")), (cost + c, audit + e))
        best = with_inserts(new)
    return min(best[s] for s in (0, 3) if s in best)


def apply(rows, audit):
    out, at = [], 0
    for e in audit:
        after = {"": "u", "s": "u", "u": "a", "a": "u"}[out[-1][0][:1] if out else ""]
        role = {"u": "user", "a": "assistant"}[after]
        if e == "I":
            out.append((role, ""))
            continue
        _, own, text = rows[at]
        at += 1
        if e != "D":
            out.append((own if e == "K" else role, text))
    assert at == len(rows) and PATTERN.match("".join(r[:1] for r, _ in out))
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


def plain(rows):
    hurt = damaged(rows)
    out = {}
    for conv in {r[0] for r in rows}:
        own = hurt.get(conv, [])
        found, initials = faults(own), [r[1][:1] for r in own]
        turns = [r[0] for r in own if r[0] is not None]
        cost, audit = cheapest(initials, found)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (gaps, found.count("b"), found.count("d"), found.count("t"), illegal, cost, audit, apply(own, audit))
    return out


def got(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


SCHEMA = "conv_id long, turn long, role string, text string"


def test_query_equals_the_plain_table(spark):
    for sf in ("sf0.001", "sf0.01"):
        rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
        assert got(conversations.op12_conversations(spark, f"/root/testdata/{sf}")) == plain(rows)


def random_rows(n, convs, seed):
    rng = random.Random(seed)
    texts = ["Fine.", "Why?", "cut off", "", " \n", "Go!", None, "x" * 300]
    roles = ["user", "assistant", "system", "tool", "", None, "u", "User"]
    return [(rng.randrange(convs), i, rng.choice(roles[: rng.choice([2, 3, 8])]), f"{i} {t}" if (t := rng.choice(texts)) and rng.random() < 0.6 else t) for i in range(n)]


def test_segments_compose_to_the_whole(spark):
    rows = random_rows(3000, 3, 1)
    frame = spark.createDataFrame(rows, SCHEMA)
    want = plain(rows)
    for segment in (1, 2, 7, 256):
        assert got(conversations.repair(conversations.damage(frame), frame, segment)) == want


def test_odd_rows(spark):
    rows = [(1, None, "user", "A."), (1, None, "user", "A."), (None, 3, None, None), (None, None, "assistant", "B!"), (2, 5, "system", "only."), (3, 9, "user", "z" * 100_000)]
    rows += [(4, i * 10, "assistant", "same.") for i in range(30)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", cost string, audit int")
    assert got(conversations.repair(conversations.damage(frame), frame)) == plain(rows)
    dropped = next(i for i in range(10_000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    frame = spark.createDataFrame([(dropped, 0, "user", "gone.")], SCHEMA)
    assert got(conversations.repair(conversations.damage(frame), frame)) == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}
    none = frame.limit(0)
    assert got(conversations.repair(conversations.damage(none), none)) == {}


def test_search_equals_trying_every_audit():
    rng = random.Random(5)
    cost_of = {"K": 0, "R": 2, "D": 3, "I": 2}
    for _ in range(60):
        n = rng.randrange(4)
        initials, found = [rng.choice("sua ") for _ in range(n)], [rng.choice(["", "", "t", "b", "d"]) for _ in range(n)]
        best = None
        for edits in itertools.product("KRD", repeat=n):
            if any(f in ("b", "d") and e != "D" for f, e in zip(found, edits)):
                continue
            for gaps in itertools.product(range(3), repeat=n + 1):
                audit = "".join("I" * g + e for g, e in zip(gaps, (*edits, "")))
                roles, at, fine = "", 0, True
                for e in audit:
                    turn = {"": "u", "s": "u", "u": "a", "a": "u"}[roles[-1:]]
                    if e != "I":
                        own, at = initials[at], at + 1
                    if e == "K":
                        fine = fine and own in "sua" and (own == turn or (own == "s" and not roles))
                        roles += own if fine else ""
                    elif e != "D":
                        roles += turn
                if fine and PATTERN.match(roles):
                    cost = sum(map(cost_of.get, audit)) + sum(f == "t" and e != "D" for f, e in zip(found, edits))
                    best = min(best or (1e9, ""), (cost, audit))
        ends = conversations.settle(initials, found, 0)
        assert min(ends[s] for s in (0, 3) if s in ends) == best == cheapest(initials, found)
