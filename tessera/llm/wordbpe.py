"""Byte-pair encoding of pre-tokens by rank-synchronous merging over ragged numpy arrays.

For tokenizer files of the kind "NFC, lower case, regular-expression pre-tokens, byte-level BPE with
a word-end suffix". Texts become code points, character classes cut them to pre-tokens, and each
distinct pre-token is encoded once and kept in a bounded table; all new ones lie
in one flat symbol array, and each round every unfinished sequence merges all places of
its own lowest-rank pair, left to right. As a merge's product only takes part in merges of higher rank (checked on
loading), this equals merging one pair at a time.

Texts that hold a special string, or a character that Unicode 3.2 had not assigned (outside the emoji
planes), are encoded by the library: their cutting depends on its options and Unicode version.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import regex
from tokenizers import Tokenizer

from tessera.llm import bytewords as bw

_NONE = np.int64(1 << 40)


def byte_symbols() -> list[str]:
    """The printable stand-ins for the 256 bytes in byte-level BPE: bytes that print stay, others follow 255."""
    stay = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = {b: chr(b) for b in stay}, 256
    for b in range(256):
        if b not in out:
            out[b], n = chr(n), n + 1
    return [out[b] for b in range(256)]


#: The contractions that the pre-token pattern names before all else (fixed values).
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
SPACE, LETTER, NUMBER, OTHER, ODD = range(5)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point; ODD where versions of Unicode may disagree."""
    out = np.full(0x110000, OTHER, np.uint8)
    chars = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for kind, pattern in ((SPACE, r"\s"), (LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
        found = "".join(regex.findall(pattern, chars))
        out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    old = unicodedata.ucd_3_2_0.category
    odd = [ord(c) for c in chars if old(c) == "Cn" and not 0x1F000 <= ord(c) < 0x1FA70]
    out[odd] = ODD
    out[0xD800:0xE000] = ODD
    return out


class WordBpe:
    #: Pre-tokens whose ids are kept; the table is emptied beyond it.
    most_known = 1_000_000

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        if pattern != "|".join([*CONTRACTIONS, r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"]):
            raise ValueError("the pre-token pattern is of another kind")
        self._path, self._loaded = path, None
        symbols = byte_symbols()
        self._inner = np.array([vocab[s] for s in symbols], np.int64)
        self._last = np.array([vocab[s + suffix] for s in symbols], np.int64)
        rank_of = {v: -1 for v in [*self._inner, *self._last]}
        keys, product = [], []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, ab = vocab[left], vocab[right], vocab[left + right]
            if max(rank_of[a], rank_of[b]) >= rank:
                raise ValueError("a merge comes before its parts")
            rank_of.setdefault(ab, rank)
            keys.append(a << 20 | b)
            product.append(ab)
        order = np.argsort(np.array(keys))
        self._keys, self._rank, self._product = np.array(keys)[order], order.astype(np.int64), np.array(product, np.int64)
        self._forget()

    @property
    def _library(self) -> Tokenizer:
        if self._loaded is None:
            self._loaded = Tokenizer.from_file(self._path)
        return self._loaded

    def _forget(self) -> None:
        self._hash, self._at, self._count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._flat = np.zeros(0, np.uint32)

    def _normal(self, text: str | None) -> str | None:
        """The text as the library normalises it (white space apart), or None if only the library may cut it."""
        if not text:
            return ""
        if any(s in text for s in self.special):
            return None
        if text.isascii():
            return text.lower()
        # lower() is by context for the Greek final sigma only; the library maps each character alone
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def _cut(self, texts: list[str]) -> tuple[bw.Words, np.ndarray]:
        """Pre-tokens of normal texts, and which texts hold odd characters."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        joined = "".join(texts)
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = classes()[code]
        bound = np.concatenate(([0], np.cumsum(size)))
        odd = np.zeros(len(texts), bool)
        odd[np.searchsorted(bound, np.flatnonzero(kind == ODD), "right") - 1] = True
        n = len(code)
        new = np.ones(n + 1, bool)
        new[1:n] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        new[bound] = True
        quote = np.flatnonzero(code == 39)
        quote = quote[new[quote] & new[quote + 1]]
        if len(quote):
            text_end = bound[np.searchsorted(bound, quote, "right")]
            after = np.append(code, [0, 0])
            one, two = after[quote + 1], np.where(quote + 2 < text_end, after[quote + 2], 0)
            one = np.where(quote + 1 < text_end, one, 0)
            taken = np.zeros(len(quote), np.int64)
            for c in reversed(CONTRACTIONS):
                match = (one == ord(c[1])) & ((two == ord(c[2])) if len(c) == 3 else True)
                taken[match] = len(c) - 1
            quote, taken = quote[taken > 0], taken[taken > 0]
            new[quote + 1] = False
            new[quote + 1 + taken] = True
        start = np.flatnonzero(new[:n])
        end = np.append(start[1:], n)
        real = kind[start] != SPACE
        start, end = start[real], end[real]
        raw = np.frombuffer(joined.encode("utf-8", "surrogatepass") + bytes(8), np.uint8)
        if len(raw) - 8 != n:
            wide = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
            byte = np.concatenate(([0], np.cumsum(wide)))
            bstart, bend = byte[start], byte[end]
        else:
            bstart, bend = start, end
        first = np.searchsorted(start, bound)
        return bw.Words(raw, bstart, bend, np.repeat(np.arange(len(texts)), np.diff(first)), first), odd

    def _learn(self, w: bw.Words, key: np.ndarray, sample: np.ndarray) -> None:
        """Encode those distinct pre-tokens (by hash, with a place of each) that aren't in the table."""
        if len(self._hash) > self.most_known:
            self._forget()
        at = np.minimum(np.searchsorted(self._hash, key), max(len(self._hash) - 1, 0))
        new = self._hash[at] != key if len(self._hash) else np.ones(len(key), bool)
        key, sample = key[new], sample[new]
        if not len(key):
            return
        sym, first = self.merge(*ragged(w.data, w.start[sample], w.end[sample] - w.start[sample]))
        where = np.searchsorted(self._hash, key)
        self._hash = np.insert(self._hash, where, key)
        self._at = np.insert(self._at, where, first[:-1] + len(self._flat))
        self._count = np.insert(self._count, where, np.diff(first))
        self._flat = np.concatenate((self._flat, sym.astype(np.uint32)))

    def _tokens(self, texts: list[str | None]):
        normal = [self._normal(t) for t in texts]
        w, odd = self._cut([t or "" for t in normal])
        odd |= np.array([t is None for t in normal], bool)
        key, sample, inverse = np.unique(w.hashes(), return_index=True, return_inverse=True)
        self._learn(w, key, sample)
        at = np.searchsorted(self._hash, key)
        other = np.flatnonzero(odd)
        told = [x.ids for x in self._library.encode_batch([texts[i] for i in other], add_special_tokens=False)] if len(other) else []
        return w, at[inverse], dict(zip(other.tolist(), told, strict=True))

    def count_batch(self, texts: list[str | None]) -> np.ndarray:
        """Number of tokens of each whole text."""
        w, at, told = self._tokens(texts)
        total = np.concatenate(([0], np.cumsum(self._count[at])))
        out = total[w.first[1:]] - total[w.first[:-1]]
        for i, ids in told.items():
            out[i] = len(ids)
        return out

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each whole text."""
        w, at, told = self._tokens(texts)
        flat, first = ragged(self._flat, self._at[at], self._count[at])
        bound = first[w.first]
        return [np.array(told[i], np.uint32) if i in told else flat[bound[i] : bound[i + 1]] for i in range(len(texts))]

    def merge(self, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Surviving symbols of the byte sequences data[first[i]:first[i + 1]] (none empty), and where each one's begin."""
        n, length = len(first) - 1, np.diff(first)
        sym = self._inner[data]
        last = first[1:] - 1
        sym[last] = self._last[data[last]]
        seq = np.repeat(np.arange(n), length)
        done_sym, done_seq = [], []
        rank, made = self._look(sym, seq, np.arange(len(sym)))
        while len(sym):
            first = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
            least = np.minimum.reduceat(rank, first)
            width = np.diff(np.append(first, len(seq)))
            finished = np.repeat(least == _NONE, width)
            if finished.any():
                done_sym.append(sym[finished])
                done_seq.append(seq[finished])
                sym, seq, rank, made = (x[~finished] for x in (sym, seq, rank, made))
                width, least = width[least != _NONE], least[least != _NONE]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, width))
            # of adjacent hits (a run of one symbol) every second merges, from the left
            run = np.concatenate(([True], np.diff(hit) != 1))
            start = hit[run][np.cumsum(run) - 1]
            hit = hit[(hit - start) % 2 == 0]
            sym[hit] = made[hit]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            at = hit - np.arange(len(hit))
            sym, seq, rank, made = sym[keep], seq[keep], rank[keep], made[keep]
            stale = np.concatenate((at, at[at > 0] - 1))
            rank[stale], made[stale] = self._look(sym, seq, stale)
        if done_sym:
            sym, seq = np.concatenate(done_sym), np.concatenate(done_seq)
            order = np.argsort(seq, kind="stable")
            sym, seq = sym[order], seq[order]
        return sym, np.searchsorted(seq, np.arange(n + 1))

    def _look(self, sym: np.ndarray, seq: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and product of the pairs that begin at these places."""
        after = np.minimum(at + 1, len(sym) - 1)
        key = sym[at] << 20 | sym[after]
        k = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        good = (self._keys[k] == key) & (seq[at] == seq[after]) & (after > at)
        return np.where(good, self._rank[k], _NONE), self._product[self._rank[k]]


def ragged(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[start[i]:start[i] + length[i]] one behind the other, and where each begins."""
    first = np.concatenate(([0], np.cumsum(length)))
    return values[np.arange(first[-1]) + np.repeat(start - first[:-1], length)], first


@lru_cache(maxsize=4)
def load(path: str) -> WordBpe:
    """One table per worker process and file."""
    return WordBpe(path)


def token_groups(texts: list[str | None], most_chars: int = 1_000_000):
    """Ranges of texts of at most so many characters (one text at least), to bound memory."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        k = len(t) if t else 0
        if size and size + k > most_chars:
            yield lo, i
            lo, size = i, 0
        size += k
    if lo < len(texts):
        yield lo, len(texts)
