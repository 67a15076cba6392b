"""Language identification by cross-parsing against suffix automata of labelled text.

A text is parsed, from the left, into the longest phrases that occur in a language's training text; the fewer phrases
a text needs for its length, the nearer the language. Phrases of a language weigh log2 of its training length, the
bits that point to a place in it. Every text with a letter has a best language; where that language's phrases make the
text longer than its symbols written one by one, it is in no language that was learned, and its score is 0.

An automaton's transitions lie in one array: those of a state at its own offset plus the symbol, in places that others
leave free. A language takes some megabytes, however many symbols all of them have.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.base import map_batches

#: Distinct texts that a language is learned from at most, those of the least hash, and the bytes of all of them together
#: (one text that is longer alone is learned whole if there is no other).
DOCS_PER_LANGUAGE, BYTES_PER_LANGUAGE = 96, 1 << 16
#: Parts in which the texts of a language are ranked before the best of all are.
PARTS = 256
#: Symbols of a segment; the segments of all texts are parsed side by side and then joined.
SEGMENT = 512
#: Phrases that tell nothing of a text's language: the first, which starts at any place, the last, which the end cuts, and
#: those at either end of one stretch in no language, such as a key or an address.
EDGES = 4
_FLAG, _STATE = np.uint32(1 << 31), np.uint32((1 << 31) - 1)
_WORD = np.uint64(32)


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton; state 0 is the start."""
    move, link, length, last = [{}], [-1], [0], 0
    for c in text:
        cur = len(move)
        move.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in move[p]:
            move[p][c] = cur
            p = link[p]
        if p >= 0:
            q = move[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(move)
                move.append(dict(move[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and move[p].get(c) == q:
                    move[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return move


def _letters(text: str) -> bytes:
    """UTF-8 of the text in lower case; the model's symbol table makes separators of what isn't a letter."""
    return text.lower().encode()


@dataclass
class Automaton:
    """Transitions of one language. ``slots`` has at state + symbol the state, plus one, whose place it is, and where it goes;
    symbols that a state has no transition for start a phrase, whose first state ``first`` has by symbol, flagged."""

    slots: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, moves: list[dict[int, int]], width: int) -> Automaton:
        """A symbol that the language doesn't have is a phrase of its own, whose state has no transitions."""
        moves = [*moves, {}]
        alone = len(moves) - 1
        moves[0] = {c: moves[0].get(c, alone) for c in range(width)}
        offset = _offsets(moves, width)
        size = int(offset.max()) + width + 1
        slots = np.zeros(size, np.uint64)
        src = np.repeat(np.arange(len(moves)), [len(m) for m in moves])
        sym = np.fromiter((c for m in moves for c in m), np.int64, len(src))
        to = np.fromiter((s for m in moves for s in m.values()), np.int64, len(src))
        slots[offset[src] + sym] = ((offset[src] + 1).astype(np.uint64) << _WORD) | offset[to].astype(np.uint64)
        return cls(slots, np.array([offset[moves[0][c]] for c in range(width)], np.uint32) | _FLAG)

    def step(self, state: np.ndarray, sym: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The next states, flagged where a phrase ends before the symbol; ``first`` is that of each symbol."""
        slot = self.slots[state + sym]
        return np.where((slot >> _WORD) == state + np.uint32(1), slot.astype(np.uint32), first)


def _offsets(moves: list[dict[int, int]], width: int) -> np.ndarray:
    """An offset for each state, no two the same, so that no two transitions have one place; the start's is 0."""
    offset = np.full(len(moves), -1, np.int64)
    offset[0] = 0
    free, taken = np.ones(width, bool), np.zeros(1, bool)
    free[:width] = False  # the start has a transition for every symbol
    taken[0] = True
    several = sorted((s for s in range(1, len(moves)) if len(moves[s]) > 1), key=lambda s: -len(moves[s]))
    grown = lambda x, n, value: np.concatenate([x, np.full(max(0, n - len(x)), value)]) if n > len(x) else x
    low = 1
    for k, s in enumerate(several):
        if k % 128 == 0:  # below, hardly any place is left for states of so many transitions
            low = max(low, len(free) - 1024 - 8 * width)
        syms, at = np.fromiter(moves[s], np.int64, len(moves[s])), low
        while offset[s] < 0:
            free, taken = grown(free, at + 1024 + width, True), grown(taken, at + 1024, False)
            fits = ~taken[at : at + 1024]
            for c in syms.tolist():
                fits &= free[at + c : at + c + 1024]
            i = int(fits.argmax())
            if fits[i]:
                offset[s] = at + i
                taken[at + i] = True
                free[at + i + syms] = False
            at += 1024
    # States with one transition fill what is free; those without any only need an offset of their own.
    one = np.array([s for s in range(1, len(moves)) if len(moves[s]) == 1], np.int64)
    sym = np.array([next(iter(moves[s])) for s in one.tolist()], np.int64)
    order = np.argsort(sym, kind="stable")
    todo, skip = order, 0
    while len(todo):
        places = np.flatnonzero(free)[skip:]
        if len(places) < len(todo):
            free = grown(free, len(free) + len(todo) + width, True)
            places = np.flatnonzero(free)[skip:]
        places = places[: len(todo)]
        own = places - sym[todo]
        taken = grown(taken, len(free) + 1, False)
        good = own > 0
        good[good] &= ~taken[own[good]]
        _, first = np.unique(own, return_index=True)
        unique = np.zeros(len(own), bool)
        unique[first] = True
        good &= unique
        offset[one[todo[good]]] = own[good]
        taken[own[good]] = True
        free[places[good]] = False
        skip = 0 if good.any() else skip + len(todo)
        todo = todo[~good]
    none = np.array([s for s in range(1, len(moves)) if not moves[s]], np.int64)
    taken = grown(taken, len(taken) + len(none), False)
    offset[none] = np.flatnonzero(~taken)[: len(none)]
    return offset


@dataclass
class Model:
    """Per language its automaton, and the bits of a phrase."""

    languages: list[str]
    symbol: np.ndarray  # of each byte; 0 for whatever separates words or was never seen
    width: int
    tables: list[Automaton]
    bits: list[float]

    def parse(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases needed, texts x languages, and symbols of each text."""
        data = [_letters(t) for t in texts]
        sym = self.symbol[np.frombuffer(b"\n".join([*data, b""]), np.uint8)]
        text_of = np.repeat(np.arange(len(texts)), [len(x) + 1 for x in data])
        keep = (sym != 0) | (np.concatenate(([0], sym[:-1])) != 0)  # one separator between words
        sym, text_of = sym[keep].astype(np.uint32), text_of[keep]
        n = np.bincount(text_of, minlength=len(texts))
        parts = -(-n // SEGMENT)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start = np.repeat(np.cumsum(n) - n, parts) + nth * SEGMENT
        size = np.minimum(SEGMENT, np.repeat(n, parts) - nth * SEGMENT)
        segments = Segments.of(sym, start, size, nth)
        out = np.zeros((len(texts), len(self.languages)))
        first = (np.cumsum(n) - n)[n > 0]
        for k, table in enumerate(self.tables):
            if len(first):
                out[n > 0, k] = 1 + np.add.reduceat(segments.path(table) >> np.uint32(31), first)
        return out, n

    def strange(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Letters of each text that have a byte never seen in training, and whether it has no others."""
        seen = {b for b in range(256) if self.symbol[b]}
        plain = bytes(b for b in range(256) if b in seen or b < 128 and not chr(b).isalpha())
        count, only = np.zeros(len(texts)), np.zeros(len(texts), bool)
        for i, t in enumerate(texts):
            if _letters(t).translate(None, plain):
                letters = {c: k for c, k in Counter(t.lower()).items() if c.isalpha()}
                count[i] = sum(k for c, k in letters.items() if not seen.issuperset(c.encode()))
                only[i] = count[i] == sum(letters.values())
        return count, only

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """Language, score, and whether the text is in a learned language at all; ``und`` and 0 for null and texts without
        letters only, or if no language was learned.

        A text is in none where the best one's phrases, but for EDGES, take more bits than the symbols written one by
        one, or no letter was seen in training. A strange letter counts as a phrase. The score is the part of the next
        best language's cost that the best one saves, 0 for a text in none; ties go to the first in order.
        """
        whole = [t if t and any(map(str.isalpha, t)) else "" for t in texts]
        if not self.languages:
            return [("und", 0.0, bool(w)) for w in whole]
        phrases, n = self.parse(whole)
        cost = phrases * np.array(self.bits)
        best = cost.argmin(1)
        least = cost[np.arange(len(cost)), best]
        strange, only = self.strange(whole)
        spelled = (n + strange) * (np.log2(self.width) + 1)  # a bit says that no phrase follows but a symbol
        known = ~only & (least + (strange - EDGES) * np.array(self.bits)[best] <= spelled)
        cost[np.arange(len(cost)), best] = np.inf
        second = cost.min(1)
        score = known * np.where(np.isfinite(second), 1 - least / np.where(second > 0, second, 1), 1.0) * (second > 0)
        return [(self.languages[b], float(s), k) if w else ("und", 0.0, False) for w, k, b, s in zip(whole, known.tolist(), best.tolist(), score.tolist(), strict=True)]


@dataclass
class Segments:
    """Whole texts, one after the other, cut into segments; the first of a text has ``nth`` 0. The symbols are there in order
    (``sym``) and by place in a segment, longer segments first (``across``): ``at`` is where each symbol stands in that."""

    sym: np.ndarray
    start: np.ndarray
    size: np.ndarray
    nth: np.ndarray
    active: np.ndarray  # segments with a symbol at each place
    at: np.ndarray
    across: np.ndarray

    @classmethod
    def of(cls, sym: np.ndarray, start: np.ndarray, size: np.ndarray, nth: np.ndarray) -> Segments:
        order = np.argsort(-size, kind="stable")
        active = np.searchsorted(-size[order], -np.arange(SEGMENT), "left")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        place = np.arange(len(sym)) - np.repeat(start, size)
        at = (np.cumsum(active) - active)[place] + np.repeat(rank, size)
        across = np.empty_like(sym)
        across[at] = sym
        return cls(sym, start, size, nth, active, at, across)

    def path(self, table: Automaton) -> np.ndarray:
        """The state after each symbol, flagged where a phrase ends before it.

        All segments are parsed at once as if each began a text. Then each goes on from where the one before it ended,
        until it comes to a state that it had before: from there on it would stay as it is. Segments after one whose end
        has changed follow, until no end changes.
        """
        met, state, upto = np.empty(len(self.sym), np.uint32), np.zeros(len(self.start), np.uint32), 0
        first = table.first[self.across]
        for m in self.active.tolist():
            k = slice(upto, upto + m)
            met[k] = table.step(state[:m], self.across[k], first[k])
            np.bitwise_and(met[k], _STATE, out=state[:m])
            upto += m
        path, todo = met[self.at], np.flatnonzero(self.nth)
        while len(todo):
            seg, place, end, changed = todo, self.start[todo], self.start[todo] + self.size[todo], []
            state = path[place - 1] & _STATE
            while len(seg):
                new = table.step(state, self.sym[place], table.first[self.sym[place]])
                old = path[place]
                path[place] = new
                state = new & _STATE
                place += 1
                other = state != (old & _STATE)
                done = other & (place == end)
                changed.append(seg[done])
                on = other & ~done
                seg, place, end, state = seg[on], place[on], end[on], state[on]
            after = np.concatenate([*changed, np.zeros(0, np.int64)]) + 1
            after = np.sort(after[after < len(self.nth)])
            todo = after[self.nth[after] > 0]
        return path


def build(samples: dict[str, list[str]]) -> Model:
    """A model of labelled texts."""
    languages = sorted(samples)
    texts = {lang: [_letters(t) for t in samples[lang]] for lang in languages}
    symbol = np.zeros(256, np.uint8)
    used = sorted({b for ts in texts.values() for t in ts for b in t if b >= 128 or chr(b).isalpha()})
    symbol[used] = np.arange(1, len(used) + 1)
    width, tables, bits = len(used) + 1, [], []
    for lang in languages:
        seq = symbol[np.frombuffer(b"\n".join(texts[lang]), np.uint8)]
        seq = seq[(seq != 0) | (np.concatenate(([0], seq[:-1])) != 0)]
        tables.append(Automaton.of(suffix_automaton(seq.tolist()), width))
        bits.append(float(np.log2(max(2, len(seq)))))
    return Model(languages, symbol, width, tables, bits)


def training_part() -> Column:
    """Documents to learn from: crc32 of the doc_id as text, modulo 4, is not 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4, F.lit(0)) != 2


def train(docs: DataFrame) -> Model:
    """Learn every language of ``lang`` from bounded text: of its distinct texts with letters, in order of hash, those
    that come to BYTES_PER_LANGUAGE together, DOCS_PER_LANGUAGE of them at most, each whole.

    Texts of a quarter of the bytes or more come last, shorter ones first; where a language has none that fits, the
    first of these is learned whole all the same. Copies become one in each task before the shuffle; the ranking keeps
    so many rows of a language in each task.
    """
    own = docs.where(training_part() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}"))
    distinct = own.groupBy("lang", F.xxhash64("text").alias("h")).agg(F.min("doc_id").alias("doc_id"), F.min(F.octet_length("text")).alias("bytes"))
    long = F.col("bytes") * 4 >= BYTES_PER_LANGUAGE
    order = F.when(long, F.col("bytes")).otherwise(0), "h"
    # First in parts of a language, so that no task has all rows of a frequent one.
    ranked = distinct.withColumn("part", F.pmod("h", F.lit(PARTS)))
    for keys in (["lang", "part"], ["lang"]):
        ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("r") <= DOCS_PER_LANGUAGE)
    upto = F.sum("bytes").over(Window.partitionBy("lang").orderBy("r").rowsBetween(Window.unboundedPreceding, 0))
    picked = ranked.withColumn("upto", upto).where((F.col("upto") <= BYTES_PER_LANGUAGE) | (F.col("r") == 1)).select("lang", "h", "doc_id", "r")
    # DOCS_PER_LANGUAGE rows a language; a row that comes twice counts once.
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", F.xxhash64("text").alias("h"), "doc_id", "text")
    found = {(r["lang"], r["r"]): r["text"] for r in rows.join(F.broadcast(picked), ["lang", "h", "doc_id"]).dropDuplicates(["lang", "r"]).collect()}
    samples: dict[str, list[str]] = {}
    for lang, r in sorted(found):
        samples.setdefault(lang, []).append(found[lang, r])
    return build(samples)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score, known.

    ``known`` is false for texts in no learned language, whose score is 0; ``und`` are those without letters. Only the text counts for a prediction. Repeated rows stay; a null doc_id is not held out; other columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few megabytes a language, by the training limits

    def make():
        model = shared.value

        def run(b: pa.RecordBatch):
            texts, i = b.column(2).to_pylist(), 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size < 4 << 20):
                    size += len(texts[j] or "")
                    j += 1
                lang, score, known = zip(*model.predict(texts[i:j]), strict=True)
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lang), pa.array(score, pa.float64()), pa.array(known)], names=["doc_id", "held_out", "lang_pred", "score", "known"])
                i = j

        return run

    return map_batches(docs.select("doc_id", (~training_part()).alias("held_out"), "text"), make, "doc_id long, held_out boolean, lang_pred string, score double, known boolean")


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is in a learned language; if none was learned, those with
    letters."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = docs.columns.index("text")

    def make():
        model = shared.value

        def run(b: pa.RecordBatch):
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                texts = part.column(text).to_pylist()
                yield part.filter(pa.array([known for _, _, known in model.predict(texts)], pa.bool_()))

        return run

    return map_batches(docs, make, docs.schema)
