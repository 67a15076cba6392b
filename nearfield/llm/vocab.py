"""Tokenizers of given vocabulary files, and a memory of the pieces they have encoded."""

from __future__ import annotations

import base64
import json
import os
import re
import unicodedata
from array import array

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

from tokenizers import Regex, Tokenizer, models, pre_tokenizers  # noqa: E402

#: Pieces of text whose ids a worker remembers; then it starts anew.
MEMORY = 250_000


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 ones for themselves, the rest from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else spare))
        spare += b not in plain
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def rank_tokenizer(ranks: dict[bytes, int], pattern: str) -> Tokenizer:
    """A byte-level BPE that joins, as ranks do, any two neighbours whose union has a rank, lowest rank first."""
    chars = byte_characters()
    written = {t: "".join(map(chars.__getitem__, t)) for t in ranks}
    joins = [(written[t[:i]], written[t[i:]]) for t in sorted(ranks, key=ranks.get) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    out = Tokenizer(models.BPE(vocab={written[t]: r for t, r in ranks.items()}, merges=joins, ignore_merges=True))
    out.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return out


def file_pattern(path: str) -> str:
    """The pattern that splits words in a file whose normalizer only composes, unifies space and lowers case."""
    with open(path) as f:
        first = json.load(f)["pre_tokenizer"]["pretokenizers"][0]
    return first["pattern"]["Regex"]


def file_tokenizer(path: str) -> Tokenizer:
    """As the library reads the file: strings of special tokens in a text become those tokens."""
    return Tokenizer.from_file(path)


def latin_pattern(pattern: str) -> re.Pattern:
    """The pattern for texts of characters under U+0100, where its classes are plain sets of characters."""
    chars = [chr(c) for c in range(256)]
    space = "".join(c for c in chars if c in "\t\n\v\f\r \x85\xa0")
    sets = {r"\p{L}": [c for c in chars if unicodedata.category(c)[0] == "L"], r"\p{N}": [c for c in chars if unicodedata.category(c)[0] == "N"], r"\s": space}
    written = {k: "".join(map(re.escape, v)) for k, v in sets.items()}

    def inside(m: re.Match) -> str:
        out = m[0]
        for k, v in written.items():
            out = out.replace(k, v)
        return out

    out = re.sub(r"\[[^\]]*\]", inside, pattern)
    for k, v in written.items():
        out = out.replace(k, f"[{v}]")
    return re.compile(out.replace(r"\S", f"[^{written[chr(92) + 's']}]"))


class Pieces:
    """Ids of pieces as little-endian 32-bit bytes; each new piece goes to the tokenizer once.

    Where all characters are under U+0100 the normalizer is lower-casing at most and the pattern one of plain sets, so
    a piece is split here and its words go straight to the tokenizer's model; other pieces take the whole way.
    """

    def __init__(self, tokenizer: Tokenizer, pattern: str, lower: bool, most: int = MEMORY):
        self.tokenizer, self.model, self.split, self.lower = tokenizer, tokenizer.model, latin_pattern(pattern), lower
        self.most, self.known, self.words = most, {}, {}
        self.written = dict(enumerate(byte_characters()))
        # Strings that the tokenizer takes out of a text, as they stand, before all else.
        self.special = {t.content: np.array([i], "<u4").tobytes() for i, t in tokenizer.get_added_tokens_decoder().items()}
        self.taken = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def _plain(self, text: str) -> bytes:
        words = self.split.findall(text.lower() if self.lower else text)
        self._learn_words(words)
        return b"".join(map(self.words.__getitem__, words))

    def _learn_words(self, words) -> None:
        known, tokenize = self.words, self.model.tokenize
        for w in words:
            if w not in known:
                text = w if w.isascii() and w.isprintable() and " " not in w else w.encode().decode("latin-1").translate(self.written)
                known[w] = array("I", [t.id for t in tokenize(text)]).tobytes()

    def _learn(self, new: list) -> None:
        other = []
        for k in new:
            text = k.decode() if isinstance(k, bytes) else k
            if (text.isascii() or max(text) < "\u0100") and not (self.taken and self.taken.search(text)):
                self.known[k] = self._plain(text)
            else:
                other.append((k, text))
        for i in range(0, len(other), 10_000):
            some = other[i : i + 10_000]
            encoded = self.tokenizer.encode_batch_fast([t for _, t in some], add_special_tokens=False)
            self.known.update((k, np.array(e.ids, "<u4").tobytes()) for (k, _), e in zip(some, encoded, strict=True))

    def encode(self, texts: list[list]) -> list[bytes]:
        """Per text, given as its pieces (str, or UTF-8 bytes), the ids of all its pieces."""
        if len(self.known) > self.most:
            self.known.clear()
        if len(self.words) > self.most:
            self.words.clear()
        known = self.known
        self._learn([x for x in set().union(*texts) if x not in known])
        get = known.__getitem__
        return [b"".join(map(get, t)) for t in texts]

    def encode_texts(self, texts: list[str], cut) -> list[bytes]:
        """Per text its ids. A text of characters under U+0100 is split by the pattern at once; others go by the pieces that
        ``cut(text)`` gives, at places where the pattern always splits. What stands between special tokens is a text of its own."""
        if self.taken and any(map(self.taken.search, texts)):
            parts = [self.taken.split(t) for t in texts]
            ids = iter(self._encode_plain([x for p in parts for x in p[::2]], cut))
            return [b"".join(next(ids) if i % 2 == 0 else self.special[x] for i, x in enumerate(p)) for p in parts]
        return self._encode_plain(texts, cut)

    def _encode_plain(self, texts: list[str], cut) -> list[bytes]:
        if len(self.words) > self.most:
            self.words.clear()
        words, other = [], []
        for i, t in enumerate(texts):
            try:
                t.encode("latin-1")
            except UnicodeEncodeError:
                other.append(i)
                words.append([])
            else:
                words.append(self.split.findall(t.lower() if self.lower else t))
        self._learn_words(set().union(*words) - self.words.keys())
        get = self.words.__getitem__
        out = [b"".join(map(get, w)) for w in words]
        if other:
            for i, ids in zip(other, self.encode([cut(texts[i]) for i in other]), strict=True):
                out[i] = ids
        return out
