"""Exact byte-level BPE by Aho-Corasick matching and backtracking.

The vocabulary's byte strings, read as Latin-1 text, form one automaton. A piece of text is encoded from left to right
with the longest match, stepping back to shorter matches whenever two adjacent tokens could not stand next to each
other in the result of the merges. Whether they can is decided by undoing the merges on both sides of their border, and
remembered. Each position is left at most once, so the work is linear in the length of the piece. The result equals the
one of applying the merges in order of rank.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

import ahocorasick
import regex

#: Fixed value: the pattern that splits text before merging, as given with the public rank files.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOKENIZERS = os.environ.get("CHATLOOM_TOKENIZERS", "/opt/tokenizers")
#: Most entries of a memo, and the longest text kept in one; longer ones are made anew.
CACHE, LONGEST = 200_000, 256


def _printable_bytes() -> dict[str, int]:
    """The alphabet of byte-level vocabularies: printable Latin-1 stands for itself, the rest follows from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranges(prop: str) -> str:
    """The characters of a Unicode property in the basic plane, as ranges for a character class."""
    plane = "".join(map(chr, range(0x10000)))
    return "".join(f"{re.escape(x[0])}-{re.escape(x[-1])}" for x in regex.findall(rf"{prop}+", plane))


def splitter():
    """A function that splits a text by ``SPLIT_PATTERN``.

    The standard library's engine does it in half the time if the classes are spelled out; texts with letters or
    digits beyond the basic plane go to the pattern as it is.
    """
    letter, digit, space = _ranges(r"\p{L}"), _ranges(r"\p{N}"), _ranges(r"\s")
    fast = re.compile(
        rf"'(?:s|t|re|ve|m|ll|d)| ?[{letter}]+| ?[{digit}]+| ?[^{space}{letter}{digit}]+|[{space}]+(?![^{space}])|[{space}]+"
    ).findall
    exact, far = regex.compile(SPLIT_PATTERN).findall, re.compile("[\U00010000-\U0010ffff]+").findall

    def split(text: str) -> list[str]:
        return exact(text) if any(regex.search(r"[\p{L}\p{N}]", x) for x in far(text)) else fast(text)

    return split


class _Memo(dict):
    """A dictionary that makes what it lacks, and keeps the first ``CACHE`` of it."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        made = self.make(key)
        if len(self) < CACHE and len(key) <= LONGEST:
            self[key] = made
        return made


class ByteBpe:
    """``encode(text)`` gives the ids of a text; null and empty texts give an empty list."""

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))["model"]
        byte = _printable_bytes()
        latin = lambda s: "".join(chr(byte[c]) for c in s)
        ids = {latin(t): i for t, i in model["vocab"].items() if all(c in byte for c in t)}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        n = max(ids.values()) + 1
        self.text = [""] * n
        for t, i in ids.items():
            self.text[i] = t
        # Rank 0.. of the merges; single bytes come before all of them.
        self.rank = list(range(-n, 0))
        self.left, self.right = list(range(n)), list(range(n))
        self.made: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(pairs):
            x, y = ids[latin(a)], ids[latin(b)]
            z = ids[latin(a) + latin(b)]
            self.made[x, y] = z
            self.rank[z], self.left[z], self.right[z] = r, x, y
        known = {t for i, t in enumerate(self.text) if t and (len(t) == 1 or self.rank[i] >= 0)}
        self.ids = {t: ids[t] for t in known}
        self.automaton = ahocorasick.Automaton()
        for t in known:
            self.automaton.add_word(t, (ids[t], len(t)))
        self.automaton.make_automaton()
        self.known, self.wide = known, [t for t in known if not t.isascii()]
        self.around: dict[tuple[int, int], set] = {}
        self.fits: dict[int, bool] = {}
        self.crossing, self.atoms, self.pieces = _Memo(self._crosses), _Memo(self._atom), _Memo(self._piece)
        self.split = splitter()

    # -- tokens of one piece ---------------------------------------------------------------------------------------

    def _fits(self, a: int, b: int) -> bool:
        """Can tokens a and b be neighbours? Undo the later of the two merges at the border until both are bytes; a
        pair on the way that merges earlier than what was undone would have been taken."""
        rank, left, right, made = self.rank, self.left, self.right, self.made
        bound = len(rank)
        x, y = a, b
        while True:
            z = made.get((x, y))
            if z is not None and rank[z] < bound:
                return False
            rx, ry = rank[x], rank[y]
            if rx < 0 and ry < 0:
                return True
            if rx > ry:
                bound, x = rx, right[x]
            else:
                bound, y = ry + 1, left[y]

    def _backtrack(self, data: str) -> bytes:
        whole = self.ids.get(data)
        if whole is not None:
            return array("i", (whole,)).tobytes()
        n = len(data)
        found: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, hit in self.automaton.iter(data):
            found[end - hit[1] + 1].append(hit)  # by growing end, so the longest is the last
        dead = bytearray(n + 1)
        out: list[int] = []
        tried: list[int] = []
        pos, k = 0, len(found[0]) - 1
        fits, size = self.fits, len(self.text)
        while pos < n:
            here = found[pos]
            while k >= 0:
                token, length = here[k]
                if not dead[pos + length]:
                    if not out:
                        break
                    key = out[-1] * size + token
                    ok = fits.get(key)
                    if ok is None:
                        ok = fits[key] = self._fits(out[-1], token)
                    if ok:
                        break
                k -= 1
            if k >= 0:
                out.append(token)
                tried.append(k)
                pos += length
                if pos < n:
                    k = len(found[pos]) - 1
            else:
                dead[pos] = 1
                pos -= len(self.text[out.pop()])
                k = tried.pop() - 1
        if len(fits) > 4 * CACHE:
            fits.clear()
        return array("i", out).tobytes()

    def _crosses(self, two: str) -> bool:
        """Can any token hold the border between these two characters? A token is known at a border by its bytes that
        fall into the two characters; it either ends inside a character or covers it."""
        a, b = (c.encode("utf-8", "replace").decode("latin-1") for c in two)
        m, n = len(a), len(b)
        around = self.around.get((m, n))
        if around is None:
            # beside a character of several bytes only tokens with such bytes matter
            tokens = self.known if m == n == 1 else self.wide
            around = self.around[m, n] = {(t[max(0, k - m) : k], t[k : k + n]) for t in tokens for k in range(1, len(t))}
        return any((a[-i:], b[:j]) in around for i in range(1, m + 1) for j in range(1, n + 1))

    def _atom(self, atom: str) -> bytes:
        return self._backtrack(atom.encode("utf-8", "replace").decode("latin-1"))

    def _piece(self, piece: str) -> bytes:
        """Cut a piece where no token can cross, which changes nothing, and encode the parts, remembered one by one."""
        if piece.isascii():
            return self._backtrack(piece)
        crossing, atoms = self.crossing, self.atoms
        out: list[bytes] = []
        atom = last = ""
        for c in piece:
            if atom:
                if crossing[last + c]:
                    atom += c
                    last = c
                    continue
                out.append(atoms[atom])
            atom = last = c
        out.append(atoms[atom])
        return b"".join(out)

    def packed(self, text: str | None) -> bytes:
        """The ids of a text as 32-bit integers side by side."""
        return b"".join(map(self.pieces.__getitem__, self.split(text))) if text else b""

    def encode(self, text: str | None) -> list[int]:
        return array("i", self.packed(text)).tolist()


@lru_cache(maxsize=2)
def tokenizer(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> ByteBpe:
    """One encoder for each Python worker."""
    return ByteBpe(os.path.join(folder, f"{name}.json"))
