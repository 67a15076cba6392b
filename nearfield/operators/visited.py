"""Sets of visited vertices for a search. An inexact one may take a new vertex for a visited one, never the reverse,
but for those that forget (cuckoo after too many moves, list beyond its room): there work is done again."""

from __future__ import annotations

from nearfield.functions.bloom import MOST_HASHES, tuned

_M64 = (1 << 64) - 1


def _spread(x: int, seed: int) -> int:
    x = (x + 0x9E3779B97F4A7C15 * (seed + 1)) & _M64
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & _M64
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & _M64
    return x ^ x >> 31


class Exact(set):
    """Any number of vertices; can forget."""

    def test(self, x: int) -> bool:
        return x in self


class Listed:
    """The first ``room`` vertices; later ones are passed over. One added twice takes two places, as in a list, but is looked up by hash."""

    def __init__(self, room: int = 1000):
        self.room, self.taken, self.seen = room, 0, set()

    def add(self, x: int) -> None:
        if self.taken < self.room:
            self.taken += 1
            self.seen.add(x)

    def test(self, x: int) -> bool:
        return x in self.seen


class Bloom:
    def __init__(self, k: int):
        power, hashes, _ = tuned(k)
        self.words, self.hashes = 1 << power, min(max(1, hashes), MOST_HASHES)
        self.bits = 0

    def _mask(self, x: int) -> int:
        a, b = _spread(x, 0), _spread(x, 1) | 1
        mask = 0
        for i in range(self.hashes):
            mask |= 1 << (a + i * b) % (64 * self.words)
        return mask

    def add(self, x: int) -> None:
        self.bits |= self._mask(x)

    def test(self, x: int) -> bool:
        m = self._mask(x)
        return self.bits & m == m


class BlockedBloom(Bloom):
    """All bits of a vertex lie in one block of 32."""

    def _mask(self, x: int) -> int:
        block, mask = _spread(x, 0) % (2 * self.words), 0
        for i in range(self.hashes):
            mask |= 1 << _spread(x, i + 1) % 32
        return mask << 32 * block


class Cuckoo:
    """Eight-bit prints in buckets of four; can forget, though it may forget another vertex of the same print."""

    BUCKET, KICKS = 4, 64

    def __init__(self, k: int):
        self.n = 1 << max(2, tuned(k)[0] - 1)
        self.buckets: list[list[int]] = [[] for _ in range(self.n)]
        self.turn = 0

    def _at(self, x: int) -> tuple[int, int, int]:
        p = _spread(x, 3) >> 56
        a = _spread(x, 0) % self.n
        return p, a, self._other(a, p)

    def _other(self, a: int, p: int) -> int:
        return a ^ _spread(p, 7) % self.n

    def add(self, x: int) -> None:
        p, a, b = self._at(x)
        for c in (a, b):
            if len(self.buckets[c]) < self.BUCKET:
                self.buckets[c].append(p)
                return
        for _ in range(self.KICKS):
            self.turn = (self.turn + 1) % self.BUCKET
            p, self.buckets[a][self.turn] = self.buckets[a][self.turn], p
            a = self._other(a, p)
            if len(self.buckets[a]) < self.BUCKET:
                self.buckets[a].append(p)
                return

    def test(self, x: int) -> bool:
        p, a, b = self._at(x)
        return p in self.buckets[a] or p in self.buckets[b]

    def discard(self, x: int) -> None:
        p, a, b = self._at(x)
        for c in (a, b):
            if p in self.buckets[c]:
                self.buckets[c].remove(p)
                return


KINDS = {"exact": lambda k: Exact(), "list": lambda k: Listed(), "bloom": Bloom, "blocked_bloom": BlockedBloom, "cuckoo": Cuckoo}
#: Those that can forget a vertex.
FORGETTING = ("exact", "cuckoo")
