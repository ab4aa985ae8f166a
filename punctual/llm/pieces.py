"""Texts cut at places where byte-level BPE never joins, so that each distinct piece is encoded once."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

_MERGES_SPACE = re.compile(r" (?:\s|$)")


def cut(text: str) -> list[str]:
    """Pieces of text, in order; a cut lies before a space that a character other than white space follows.

    The byte-level pattern takes such a space together with what follows, never with what precedes.
    """
    first, *rest = text.split(" ")
    if not _MERGES_SPACE.search(text):
        return [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]
    pieces = [first]
    for x in rest:
        if x and not x[0].isspace():
            pieces.append(" " + x)
        else:
            pieces[-1] += " " + x
    return pieces if first or pieces[0] else pieces[1:]


class Remembered(dict):
    """piece -> encoding. Up to `most` pieces stay; later ones are at hand, in `passing`, until the next texts."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.passing = most, {}

    def __missing__(self, piece: str):
        return self.passing[piece]

    def unknown(self, cuts) -> list[str]:
        self.passing = {}
        return list({p for c in cuts for p in c}.difference(self))

    def add(self, piece: str, encoding) -> None:
        (self if len(self) < self.most else self.passing)[piece] = encoding


#: White space other than space and line end, and the mark of literal keys.
_ODD = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\x00]")
_RUNS = ("  ", " \n", "\n ", "\n\n")
#: A mark of punctuation alone behind a letter or digit: the pattern makes it a word of its own.
_MARK = re.compile("[.,](?=[ \n]|\\Z)(?<=[A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f].)")  # looks back last: marks are few, other characters many


def keys_of(text: str) -> list[str]:
    """The pieces of text as keys: a key that begins with U+0000 stands for what follows it, any other one for itself behind a space."""
    if not text:
        return []
    if any(x in text for x in _RUNS) or text[0].isspace() or text[-1].isspace() or (not text.replace("\n", "").isprintable() and _ODD.search(text)):
        return [p[1:] if p[:1] == " " and p[1:2] not in ("", " ", "\x00") else "\x00" + p for p in cut(text)]
    text = _MARK.sub(" \x00\\g<0>", text)
    if "\n" in text:
        text = text.replace("\n", " \x00\n \x00")
    keys = text.split(" ")
    keys[0] = "\x00" + keys[0]
    return keys


class _Numbers(dict):
    """key -> number in order of appearance; `new` lists the keys that appeared since it was emptied."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        self.new.append(key)
        return n


class PieceTable:
    """Token ids of the pieces met so far, in one array. Up to `most` pieces stay, later ones until the next texts.

    encode gives the ids of each of many texts, size_of the bytes of each id. Pieces are encoded joined to longer
    texts; as a cut is never joined over, the bytes of the ids tell which belong to which piece.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], size_of: np.ndarray, most: int):
        self.encode, self.size_of, self.most = encode, size_of, most
        self.number, self.ids, self.at = _Numbers(), np.empty(1 << 20, "<u4"), np.zeros((1 << 16) + 1, np.int64)

    def _append(self, ids: np.ndarray, counts: np.ndarray, first: int) -> None:
        begin, n = self.at[first], len(counts)
        while begin + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while first + n >= len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        self.ids[begin : begin + len(ids)] = ids
        self.at[first + 1 : first + n + 1] = begin + np.cumsum(counts)

    def _joined(self, pieces: list[str], extra: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their counts of pieces that are encoded in one text; the last `extra` ids of each are dropped."""
        if not pieces:
            return np.empty(0, "<u4"), np.empty(0, np.int64)
        ids = np.array(self.encode(["".join(pieces)])[0], "<u4")
        ends = np.searchsorted(np.cumsum(self.size_of[ids]), np.cumsum([len(x.encode()) for x in pieces])) + 1
        keep = np.ones(len(ids), bool)
        if extra:
            keep[ends - 1] = False
        return ids[keep], np.diff(ends, prepend=0) - extra

    def _learn(self, new: list[str], first: int, never: list[str]) -> None:
        """Pieces behind a space are joined as they are, others one a line, and those that end in white space are encoded alone."""
        for k in range(0, len(new), 4096):
            part = new[k : k + 4096]
            literal = [i for i, x in enumerate(part) if x[0] == "\x00"]
            alone = [i for i in literal if part[i][1:2].isspace() or part[i][-1:].isspace() or any(a in part[i] for a in never)]
            lines = sorted(set(literal).difference(alone))
            spaced = sorted(set(range(len(part))).difference(literal))
            own = [(spaced, *self._joined([" " + part[i] for i in spaced], 0)), (lines, *self._joined([part[i][1:] + "\n" for i in lines], 1))]
            ids = [np.array(x, "<u4") for x in self.encode([part[i][1:] for i in alone])] if alone else []
            own.append((alone, np.concatenate(ids) if ids else np.empty(0, "<u4"), np.array([len(x) for x in ids], np.int64)))
            count = np.zeros(len(part), np.int64)
            for at, _, n in own:
                count[at] = n
            begin, out = np.cumsum(count) - count, np.empty(count.sum(), "<u4")
            for at, x, n in own:
                out[np.repeat(begin[at] - (np.cumsum(n) - n), n) + np.arange(len(x))] = x
            self._append(out, count, first + k)

    def texts(self, texts: list[str | None], never: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts, end_id behind each text, and how many each has. A text that holds one of `never` is not cut."""
        for key in self.number.new:
            del self.number[key]
        self.number.new = []
        keys, sizes = [], []
        for t in texts:
            own = keys_of(t or "") if not any(a in (t or "") for a in never) else ["\x00" + t]
            keys += own
            sizes.append(len(own))
        before = len(self.number)
        number = np.fromiter(map(self.number.__getitem__, keys), np.int64, len(keys))
        new = self.number.new
        self._learn(new, before, never)
        self.number.new = new[max(0, self.most - before) :]
        count = self.at[number + 1] - self.at[number]
        total = np.cumsum(count)
        ends = np.cumsum(sizes)
        upto = np.where(ends > 0, total[np.maximum(ends, 1) - 1], 0) if len(keys) else np.zeros(len(texts), np.int64)
        n = np.diff(upto, prepend=0) + 1
        flat = np.repeat(self.at[number] - (total - count), count) + np.arange(total[-1] if len(keys) else 0)
        out = np.full(int(n.sum()), end_id, "<u4")
        behind = np.ones(len(out), bool)
        behind[np.cumsum(n) - 1] = False
        out[behind] = self.ids[flat]
        return out, n
