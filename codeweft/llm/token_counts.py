"""Token counts by a finite-state transducer compiled from a tokenizer's pieces.

The tokenizer merges the best-scored pair of neighbours, leftmost first, until none is left. Two facts make
that a finite-state job. A boundary that survives splits the work in two, so a sequence of pieces is the
tokenizer's iff every pair of neighbours alone is; hence the last piece of every prefix is the one suffix
piece that agrees with the last piece of what stands before it. And pieces are short, so only the beginnings
of pieces that may still be running matter. A state is thus the list of running beginnings, each with the
piece before it and the tokens counted since; a transition reads one character and emits how many tokens
the prefix has more (or fewer) than before. States are compiled when they are first met and kept in a
table of bounded size that starts afresh when full; what a state means doesn't depend on the table.

Two neighbours that no piece has inside it are a synchronising place: the state after it is the same whatever
came before. A text is cut into chunks. A chunk maps every entry state to an exit state and a count; the map
is written as its head (what stands before its first synchronising place, and depends on the entry) and a
constant rest, so it is small though it holds for all states. Maps compose, associatively, by running the
right head from the left exit; a parallel prefix scan composes the maps of a text in log2(chunks) rounds.
All stretches of all chunks of a batch run side by side, equal stretches once.

Results for odd input: null and empty texts have no bytes and no tokens; repeated rows are counted each; long
texts are read in slabs, and an unbroken stretch of any length is followed to its end; a null id stays null;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns, table

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
CHUNK_BYTES = 8 << 10
SLAB_BYTES = 1 << 20
#: Compiled states and transitions that a worker keeps.
MOST_STATES, MOST_TRANSITIONS = 300_000, 1_000_000
#: Slots of the table of transitions, as a power of two.
SLOT_BITS = 22
#: With fewer stretches left than this, one at a time is faster than side by side.
FEW = 24
SPACE = "▁"


@dataclass(frozen=True)
class ChunkMap:
    """``head``: symbols that depend on the entry; ``whole``: nothing else is in the chunk; else ``count`` and ``exit`` of the rest."""

    head: np.ndarray
    whole: bool
    count: int
    exit: object


class Transducer:
    """Reads symbols (small numbers for characters), emits differences of token counts."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as model

        proto = model.ModelProto()
        with open(path, "rb") as data:
            proto.ParseFromString(data.read())
        kind = model.ModelProto.SentencePiece
        norm, trained = proto.normalizer_spec, proto.trainer_spec
        if trained.model_type != model.TrainerSpec.BPE or not trained.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not (norm.add_dummy_prefix and norm.escape_whitespaces) or trained.treat_whitespace_as_suffix or any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in proto.pieces):
            raise ValueError(f"{path}: only merging models with byte fallback and texts taken as they are can be compiled")
        self.score = {p.piece: p.score for p in proto.pieces if p.type == kind.NORMAL}
        self.begins = {p[:i] for p in self.score for i in range(1, len(p))}
        self.chars = sorted({c for p in self.score for c in p})
        n = len(self.chars)
        #: Symbols: the pieces' characters, then one for others of one to four bytes each.
        self.size = n + 4
        points = np.arange(0x110000)
        self.symbol = (n + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)).astype(np.uint16)
        self.symbol[[ord(c) for c in self.chars]] = np.arange(n)
        self.space = int(self.symbol[ord(SPACE)])
        self.symbol[ord(" ")] = self.space
        self.joined = np.zeros((self.size * self.size + 7) // 8, np.uint8)
        for p in self.score:
            for a, b in zip(p, p[1:]):
                k = int(self.symbol[ord(a)]) * self.size + int(self.symbol[ord(b)])
                self.joined[k >> 3] |= 1 << (k & 7)
        self.clear()

    def clear(self) -> None:
        self.states, self.ids, self.agreed = [], {}, {}
        self.next: dict[int, tuple[int, int]] = {}
        # The same transitions by slot, for many lookups at once: key, next state, tokens more.
        self.slot_keys = np.full(1 << SLOT_BITS, -1, np.int64)
        self.slot_to, self.slot_more = np.zeros(1 << SLOT_BITS, np.int32), np.zeros(1 << SLOT_BITS, np.int8)
        self.start = self._id((("", None, 0),))

    def _id(self, state: tuple) -> int:
        if (found := self.ids.get(state)) is None:
            found = self.ids[state] = len(self.states)
            self.states.append(state)
        return found

    def tidy(self) -> None:
        """Start afresh if full; ids given out before are void then."""
        if len(self.states) > MOST_STATES or len(self.next) > MOST_TRANSITIONS:
            self.clear()

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text: best score first, leftmost of equals."""
        parts, score = list(text), self.score
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def agree(self, before: str | None, piece: str) -> bool:
        """Do the pieces stay as they are side by side? ``before`` None: anything that can't be joined."""
        key = (before, piece)
        if (found := self.agreed.get(key)) is None:
            found = self.agreed[key] = self.merged((before or "") + piece) == ([before, piece] if before else [piece])
        return found

    def is_joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        k = a.astype(np.int64) * self.size + b
        return (self.joined[k >> 3] >> (k & 7).astype(np.uint8)) & 1 > 0

    def _joins(self, a: str, b: str) -> bool:
        k = int(self.symbol[ord(a)]) * self.size + int(self.symbol[ord(b)])
        return bool(self.joined[k >> 3] >> (k & 7) & 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot that holds each key, or the free one where it would be put."""
        with np.errstate(over="ignore"):
            slots = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        there = self.slot_keys[slots]
        away = np.flatnonzero((there != keys) & (there >= 0))
        while len(away):
            slots[away] = (slots[away] + 1) & ((1 << SLOT_BITS) - 1)
            there = self.slot_keys[slots[away]]
            away = away[(there != keys[away]) & (there >= 0)]
        return slots

    def steps(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``step`` for many state-and-symbol keys."""
        slots = self._slots(keys)
        if len(new := np.flatnonzero(self.slot_keys[slots] != keys)):
            fresh = np.unique(keys[new])
            found = np.array([self.step(*divmod(key, self.size)) for key in fresh.tolist()], np.int64)
            if len(self.next) < 1 << (SLOT_BITS - 1):
                while len(fresh):
                    _, one = np.unique(free := self._slots(fresh), return_index=True)  # one key for each free slot, the others next time
                    self.slot_keys[free[one]] = fresh[one]
                    self.slot_to[free[one]], self.slot_more[free[one]] = found[one].T
                    fresh, found = np.delete(fresh, one), np.delete(found, one, axis=0)
            slots = self._slots(keys)
        to, more = self.slot_to[slots].astype(np.int64), self.slot_more[slots].astype(np.int64)
        for i in np.flatnonzero(self.slot_keys[slots] != keys).tolist():  # a table over half full takes no more
            to[i], more[i] = self.step(*divmod(int(keys[i]), self.size))
        return to, more

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        """Next state and tokens more; compiled when first asked for."""
        key = state * self.size + symbol
        if (found := self.next.get(key)) is not None:
            return found
        if symbol >= len(self.chars):  # not in any piece: a token for each byte, and nothing runs across it
            found = self.next[key] = (self.start, symbol - len(self.chars) + 1)
            return found
        char, running, last, more = self.chars[symbol], [], None, 0
        for begun, before, since in self.states[state]:
            if not begun and before is not None and not self._joins(before[-1], char):
                before = None
            piece = begun + char
            if last is None and piece in self.score and self.agree(before, piece):
                last, more = piece, 1 - since
            if piece in self.begins:
                running.append((piece, before, since))
        if last is None:
            raise ValueError(f"no piece ends with {char!r}")
        state = (*((piece, before, since + more) for piece, before, since in running), ("", last, 0))
        found = self.next[key] = (self._id(state), more)
        return found

    def run(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exit states and counts of stretches ``symbols[start:start + length]``, side by side."""
        states, counts = states.copy(), np.zeros(len(starts), np.int64)
        order = np.argsort(-lengths, kind="stable")
        falling, k = -lengths[order], 0
        while True:
            left = int(np.searchsorted(falling, -k, "left"))
            if left < FEW:
                break
            now = order[:left]
            states[now], more = self.steps(states[now] * self.size + symbols[starts[now] + k])
            counts[now] += more
            k += 1
        for i in order[:left].tolist():
            state, total = int(states[i]), int(counts[i])
            for symbol in symbols[starts[i] + k : starts[i] + lengths[i]].tolist():
                state, more = self.step(state, symbol)
                total += more
            states[i], counts[i] = state, total
        return states, counts

    def maps(self, symbols: np.ndarray, chunk_starts: np.ndarray, first: np.ndarray) -> list[ChunkMap]:
        """The map of each chunk; ``first``: it begins a text, so its entry is the start."""
        n, m = len(symbols), len(chunk_starts)
        cut = np.ones(n, bool)
        cut[1:] = ~self.is_joined(symbols[:-1], symbols[1:])
        cut[chunk_starts] = True
        starts = np.flatnonzero(cut)
        lengths = np.diff(starts, append=n)
        firsts = np.searchsorted(starts, chunk_starts)  # each chunk's first stretch
        lasts = np.append(firsts[1:], len(starts)) - 1
        chunk = np.repeat(np.arange(m), lasts - firsts + 1)
        is_head = np.zeros(len(starts), bool)
        is_head[firsts[~first]] = True
        rest = np.flatnonzero(~is_head)
        exits, counts = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        if len(rest):
            exits[rest], counts[rest] = self._distinct(symbols, starts[rest], lengths[rest])
        totals = np.bincount(chunk, counts, m).astype(np.int64)
        out = []
        for c in range(m):
            head = is_head[firsts[c]]
            symbols_of = symbols[starts[firsts[c]] : starts[firsts[c]] + lengths[firsts[c]]].copy() if head else symbols[:0]
            whole = bool(head and firsts[c] == lasts[c])
            out.append(ChunkMap(symbols_of, whole, int(totals[c]), None if whole else self.states[exits[lasts[c]]]))
        return out

    def _distinct(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``run`` from the start state, once for equal stretches."""
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(len(symbols) + 1, 0x9E3779B97F4A7C15, np.uint64))
            inverse = np.cumprod(np.full(len(symbols) + 1, pow(0x9E3779B97F4A7C15, -1, 1 << 64), np.uint64))
            sums = np.zeros(len(symbols) + 1, np.uint64)
            np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * power[:-1], out=sums[1:])
            mark = (sums[starts + lengths] - sums[starts]) * inverse[starts]
        _, one, at = np.unique(mark, return_index=True, return_inverse=True)
        # Equal marks are held against the symbols themselves, so a clash of marks changes nothing.
        like = one[at]
        same = lengths[like] == lengths
        inner = np.repeat(np.cumsum(lengths) - lengths, lengths)
        offset = np.arange(int(lengths.sum())) - inner
        row = np.repeat(np.arange(len(starts)), lengths)
        other = np.minimum(np.repeat(starts[like], lengths) + offset, len(symbols) - 1)
        differs = symbols[np.repeat(starts, lengths) + offset] != symbols[other]
        same[row[differs]] = False
        odd = np.flatnonzero(~same)
        chosen = np.concatenate([one, odd])
        exits, counts = self.run(symbols, starts[chosen], lengths[chosen], np.full(len(chosen), self.start, np.int64))
        at[odd] = len(one) + np.arange(len(odd))
        return exits[at], counts[at]

    def compose(self, left: list[ChunkMap], right: list[ChunkMap]) -> list[ChunkMap]:
        """The maps of ``left`` and then ``right``, pair by pair."""
        known = [i for i, a in enumerate(left) if not a.whole]
        heads = [right[i].head for i in known]
        lengths = np.array([len(h) for h in heads], np.int64)
        entries = np.array([self._id(left[i].exit) for i in known], np.int64)
        exits, counts = self.run(np.concatenate([*heads, np.zeros(0, np.uint16)]), np.cumsum(lengths) - lengths, lengths, entries)
        out = [replace(b, head=np.concatenate([a.head, b.head])) if a.whole else None for a, b in zip(left, right)]
        for i, state, n in zip(known, exits.tolist(), counts.tolist()):
            a, b = left[i], right[i]
            out[i] = ChunkMap(a.head, False, a.count + n + (0 if b.whole else b.count), self.states[state] if b.whole else b.exit)
        return out

    def scan(self, maps: list[ChunkMap], text: list[int]) -> list[ChunkMap]:
        """For each chunk the map of its text up to its end: an inclusive scan over doubling distances within each text."""
        far, maps = 1, list(maps)
        while some := [i for i in range(far, len(maps)) if text[i - far] == text[i]]:
            for i, composed in zip(some, self.compose([maps[i - far] for i in some], [maps[i] for i in some])):
                maps[i] = composed
            far *= 2
        return maps

    def symbols_of(self, raw: bytes, begins: bool) -> np.ndarray:
        """Symbols of whole characters, after the space that is put before a text."""
        points = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        symbols = self.symbol[points]
        return np.concatenate([np.array([self.space], np.uint16), symbols]) if begins and len(symbols) else symbols

    def count(self, texts: list[bytes], chunk_bytes: int = CHUNK_BYTES, slab_bytes: int = SLAB_BYTES) -> list[int]:
        """The number of tokens of each text."""
        maps: list[ChunkMap] = []
        owner: list[int] = []
        counts = [0] * len(texts)
        held: list[tuple[np.ndarray, bool, int]] = []
        size = 0

        def flush() -> None:
            nonlocal held, size
            if held:
                self.tidy()
                lengths = np.array([len(s) for s, _, _ in held])
                maps.extend(self.maps(np.concatenate([s for s, _, _ in held]), np.cumsum(lengths) - lengths, np.array([f for _, f, _ in held])))
                owner.extend(i for _, _, i in held)
            held, size = [], 0

        def close() -> None:
            self.tidy()
            for i, whole in zip(owner, self.scan(maps, owner)):
                counts[i] = whole.count  # the last chunk's stays
            maps.clear()
            owner.clear()

        for i, raw in enumerate(texts):
            at = 0
            while at < len(raw):
                to = min(at + chunk_bytes, len(raw))
                while to < len(raw) and raw[to] & 0xC0 == 0x80:  # whole characters only
                    to += 1
                held.append((self.symbols_of(raw[at:to], at == 0), at == 0, i))
                size += to - at
                at = to
                if size >= slab_bytes:
                    flush()
            if size >= slab_bytes // 2:
                flush()
            if len(maps) >= 1024 and not held:
                close()
        flush()
        close()
        return counts


@lru_cache(maxsize=2)
def compiled(path: str) -> Transducer:
    return Transducer(path)


def token_counts(docs: DataFrame, limit: int = LIMIT, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row; ``model``: a file of merging pieces that every machine has."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_raw"))

    def run(batch):
        import public_tokenizers

        transducer = compiled(model or public_tokenizers.path(MODEL))
        raw = batch.column("_raw").to_pylist()
        return [[len(x) for x in raw], transducer.count(raw)]

    return map_columns(rows, ["doc_id"], "n_bytes long, n_tokens long", run).withColumn("over_limit", F.col("n_tokens") > limit)


def op11_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
