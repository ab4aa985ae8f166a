"""Byte-level BPE by ranks, encoding and decoding, with pre-tokenisation by a scan over transition functions.

The split pattern of byte-level BPE is an automaton over classes of code points. A code point is
then a function from state to state, and functions compose: the state before each character is an
associative scan of the functions of the characters before it. The functions that arise are few, so
each has a number and composition is a table; a text of n characters costs a few lookups a character
in numpy, with no regular expression and no step a character in Python. What an automaton can
only tell one character late (the last blank before a word, the letter of an unfinished 're) it tells
as a boundary before the previous character.

Between boundaries lie slices of the text's UTF-8 bytes. Each distinct one is merged once a worker.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctual.llm.common import worker_table
from punctual.llm.pieces import PieceTable
from punctual.llm.trie_bpe import read_definition

#: Classes of code points; END lies behind each text.
END, SPACE, BLANK, LETTER, SINGLE, R, V, L, E, NUMBER, QUOTE, OTHER = range(12)
#: States: at a match's start, in a run of letters, numbers or others, behind one or more blanks (by the last one), in a contraction, behind one.
START, LETTERS, NUMBERS, OTHERS, ONE_SPACE, SPACES, ONE_BLANK, BLANKS, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L, DONE = range(13)
#: A step emits these: a boundary before its character, a boundary before the previous one.
HERE, BEFORE = 1, 2
#: White space other than U+0020, and the letters of contractions.
_WHITE = [*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_CONTRACTION = {"s": SINGLE, "t": SINGLE, "m": SINGLE, "d": SINGLE, "r": R, "v": V, "l": L, "e": E}
#: Characters of a step, characters of a row of the scan, slices a worker remembers, bytes of slices that are merged side by side.
STEP, ROW, REMEMBERED, SHORT = 1 << 20, 64, 400_000, 64


def step(state: int, kind: int) -> tuple[int, int]:
    """The state behind a character of this class, and the boundaries it emits."""
    unfinished = state in (QUOTED_R, QUOTED_V, QUOTED_L)
    if kind == END:
        return START, HERE | (BEFORE if unfinished else 0)
    if kind in (SPACE, BLANK):
        if ONE_SPACE <= state <= BLANKS:
            return (SPACES if kind == SPACE else BLANKS), 0
        return (ONE_SPACE if kind == SPACE else ONE_BLANK), HERE | (BEFORE if unfinished else 0)
    letter = LETTER <= kind <= E
    run = LETTERS if letter else NUMBERS if kind == NUMBER else OTHERS
    alone = QUOTED if kind == QUOTE else run
    if state in (ONE_SPACE, SPACES):
        return run, BEFORE if state == SPACES else 0
    if state == BLANKS:
        return alone, HERE | BEFORE
    if state == QUOTED:
        known = {SINGLE: DONE, R: QUOTED_R, V: QUOTED_V, L: QUOTED_L}.get(kind)
        return (known, 0) if known else (run, 0 if run == OTHERS else HERE)
    if unfinished and kind == (L if state == QUOTED_L else E):
        return DONE, 0
    late = BEFORE if unfinished else 0
    now = LETTERS if unfinished else state
    return (run, late) if now == run else (alone, late | HERE)


class Scan:
    """The automaton's functions, numbered; compose[f * size + g] is f, then g."""

    def __init__(self):
        classes = [tuple(step(s, kind)[0] for s in range(13)) for kind in range(12)]
        functions = list(dict.fromkeys([tuple(range(13)), *classes]))
        number = {f: k for k, f in enumerate(functions)}
        self.of_class = np.array([number[f] for f in classes], np.uint8)
        for f in functions:  # grows while it is walked: all products with a generator
            for g in self.of_class:
                if (both := tuple(functions[g][x] for x in f)) not in number:
                    number[both] = len(functions)
                    functions.append(both)
        self.size = len(functions)
        assert self.size <= 256
        self.compose = np.array([[number[tuple(g[x] for x in f)] for g in functions] for f in functions], np.uint8).ravel()
        self.apply = np.array(functions, np.uint8).ravel()
        self.emits = np.array([[step(s, kind)[1] for kind in range(12)] for s in range(13)], np.uint8).ravel()

    def _then(self, f: np.ndarray, g: np.ndarray) -> np.ndarray:
        return self.compose[f.astype(np.uint16) * self.size + g]

    def _rows(self, functions: np.ndarray) -> np.ndarray:
        """Inclusive scans of rows of ROW functions each, one a column."""
        n = -(-len(functions) // ROW)
        padded = np.zeros(n * ROW, np.uint8)
        padded[: len(functions)] = functions
        grid = np.ascontiguousarray(padded.reshape(n, ROW).T)
        for k in range(1, ROW):
            grid[k] = self._then(grid[k - 1], grid[k])
        return grid

    def totals(self, functions: np.ndarray) -> np.ndarray:
        """The inclusive scan: rows side by side, their totals likewise, and each row behind the total of those before it."""
        grid = self._rows(functions)
        if grid.shape[1] > 1:
            before = np.concatenate([np.zeros(1, np.uint8), self.totals(grid[-1])[:-1]])
            grid = self._then(np.broadcast_to(before, grid.shape), grid)
        return grid.T.ravel()[: len(functions)]

    def boundaries(self, kinds: np.ndarray) -> np.ndarray:
        """Where matches begin, for classes of characters from a match's start on; END is a match of its own. The last character's is not yet certain."""
        state = np.empty(len(kinds), np.uint16)
        state[:1] = START
        state[1:] = self.apply[self.totals(self.of_class[kinds])[:-1].astype(np.uint16) * 13 + START]
        emitted = self.emits[state * 12 + kinds]
        begins = emitted & HERE
        begins[:-1] |= emitted[1:] >> 1
        return np.flatnonzero(begins)


def class_table() -> np.ndarray:
    """The class of every code point. Where Python's and regex's editions of Unicode differ on a letter or number, that of the tiktoken library is asked."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, range(0x110000)))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for run in regex.finditer(pattern, every):
            kinds[run.start() : run.end()] = kind
    python = np.array([{"L": LETTER, "N": NUMBER}.get(unicodedata.category(c)[0], OTHER) for c in every], np.uint8)
    ranks = [bytes([b]) for b in range(256)] + [bytes([ord(x), b]) for x in "a1" for b in range(0x80, 0x100)]
    library = tiktoken.Encoding("classes", pat_str=r" ?\p{L}+| ?\p{N}+|[^\p{L}\p{N}]", mergeable_ranks={t: k for k, t in enumerate(ranks)}, special_tokens={})
    for c in np.flatnonzero(kinds != python).tolist():
        joined = [library.encode_ordinary(x + chr(c))[0] > 0xFF for x in "a1"]
        kinds[c] = LETTER if joined[0] else NUMBER if joined[1] else OTHER
    kinds[_WHITE] = BLANK
    kinds[ord(" ")], kinds[ord("'")] = SPACE, QUOTE
    for letter, kind in _CONTRACTION.items():
        kinds[ord(letter)] = kind
    return kinds


def read_ranks(definition: str) -> dict[bytes, int]:
    """Lines of a token in base64 and its rank."""
    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in definition.splitlines() if line.strip())}
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"the ranks lack {len(missing)} single bytes")
    return ranks


class Pairs:
    """The rank of the joined bytes of two tokens, by their ids, in an open-addressed table; NONE if they have none."""

    NONE = np.int64(1 << 40)

    def __init__(self, ranks: dict[bytes, int]):
        found = [(ranks[t[:k]] << 32 | ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        keys, values = np.array([k for k, _ in found], np.uint64), np.array([r for _, r in found], np.int64)
        self.bits = max(8, int(4 * len(found)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, ~np.uint64(0)), np.full(1 << self.bits, self.NONE)
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] == ~np.uint64(0)
            self.keys[at[free]] = keys[free]  # of several for one slot the last stays
            placed = self.keys[at] == keys
            self.values[at[placed]] = values[placed]
            keys, values, at = keys[~placed], values[~placed], (at[~placed] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        at = self._slot(keys)
        out = np.where(self.keys[at] == keys, self.values[at], self.NONE)
        left_over = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] != ~np.uint64(0)))
        while len(left_over):
            at[left_over] = (at[left_over] + 1) & ((1 << self.bits) - 1)
            own = self.keys[at[left_over]]
            hit = left_over[own == keys[left_over]]
            out[hit] = self.values[at[hit]]
            left_over = left_over[(own != keys[left_over]) & (own != ~np.uint64(0))]
        return out


def merged(pieces: list[bytes], single: np.ndarray, pairs: Pairs) -> tuple[np.ndarray, np.ndarray]:
    """Pair merging of many short pieces side by side: ids of all, and how many each has.

    Of a piece's neighbours whose joined bytes have a rank the least is joined first, the leftmost of equals: one a round in every piece.
    """
    ids = single[np.frombuffer(b"".join(pieces), np.uint8)]
    size = np.array([len(x) for x in pieces], np.int64)
    count, active = size.copy(), np.arange(len(pieces))
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    last = np.cumsum(size) - 1
    rank = np.full(len(ids), Pairs.NONE)
    rank[:-1] = pairs(ids[:-1], ids[1:])
    rank[last] = Pairs.NONE
    while len(active):
        begin = np.cumsum(count) - count
        least = np.minimum.reduceat(rank, begin)
        over = least == Pairs.NONE
        if over.any():
            gone = np.repeat(over, count)
            done.append((active[over], count[over], ids[gone]))
            ids, rank, active, count, least = ids[~gone], rank[~gone], active[~over], count[~over], least[~over]
            if not len(active):
                break
        of = np.repeat(np.arange(len(active)), count)
        at = np.flatnonzero(rank == least[of])
        at = at[np.diff(of[at], prepend=-1) > 0]  # the leftmost of each piece
        ids[at] = rank[at]
        keep = np.ones(len(ids), bool)
        keep[at + 1] = False
        rank[at] = rank[at + 1]  # the end of a piece stays one
        ids, rank, of, count = ids[keep], rank[keep], of[keep], count - 1
        at = at - np.arange(len(at))
        inner = at[(at + 1 < len(ids)) & (of[np.minimum(at + 1, len(ids) - 1)] == of[at])]
        rank[inner] = pairs(ids[inner], ids[inner + 1])
        inner = at[(at > 0) & (of[at - 1] == of[at])] - 1
        rank[inner] = pairs(ids[inner], ids[inner + 1])
    count = np.zeros(len(pieces), np.int64)
    for own, n, _ in done:
        count[own] = n
    out, begin = np.empty(count.sum(), "<u4"), np.cumsum(count) - count
    for own, n, found in done:
        out[np.repeat(begin[own] - (np.cumsum(n) - n), n) + np.arange(len(found))] = found
    return out, count


def merged_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same of one long piece, with a heap of neighbours, in n log n steps."""
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that begins here; -1: none
    longest = max(map(len, ranks))

    def rank(k: int) -> int | None:
        return ranks.get(piece[k : end[end[k]]]) if end[k] < n and end[end[k]] - k <= longest else None

    heap = [(r, k, k + 2) for k in range(n - 1) if (r := rank(k)) is not None]
    heapq.heapify(heap)
    gone = bytearray(n)
    while heap:
        _, k, upto = heapq.heappop(heap)
        if gone[k] or end[k] >= n or end[end[k]] != upto or end[k] == upto:
            continue
        gone[end[k]] = 1
        end[k] = upto
        if upto < n:
            before[upto] = k
        for x in (k, before[k]):
            if x >= 0 and (r := rank(x)) is not None:
                heapq.heappush(heap, (r, x, end[end[x]]))
    out, k = [], 0
    while k < n:
        out.append(ranks[piece[k : end[k]]])
        k = end[k]
    return out


class Slices(PieceTable):
    """Token ids of slices met before."""

    def ids_of(self, slices: list[bytes], merge: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all slices, and how many each has; merge gives both for new ones."""
        before = len(self.number)
        number = np.fromiter(map(self.number.__getitem__, slices), np.int64, len(slices))
        new = self.number.new
        if new:
            self._append(*merge(new), before)
        count = self.at[number + 1] - self.at[number]
        found = self.ids[np.repeat(self.at[number] - (np.cumsum(count) - count), count) + np.arange(count.sum())]
        for key in new[max(0, self.most - before) :]:
            del self.number[key]
        self.number.new = []
        return found, count


class ByteBPE:
    """definition: the text of a rank file, a line for each token in base64 and its rank."""

    def __init__(self, definition: str):
        self.ranks = read_ranks(definition)
        tokens = sorted(self.ranks.items(), key=lambda x: x[1])
        size = np.zeros(tokens[-1][1] + 1, np.int64)
        size[[r for _, r in tokens]] = [len(t) for t, _ in tokens]
        self.size_of, self.table = size, Slices(None, size, REMEMBERED)
        self.all_bytes = np.frombuffer(b"".join(t for t, _ in tokens), np.uint8)
        self.begin = np.cumsum(size) - size
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.pairs, self.scan, self.kinds = Pairs(self.ranks), Scan(), class_table()

    def _slices(self, text: str, ends: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """The slices of joined texts with one character behind each, at ends, and which text each is of."""
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        kinds = self.kinds[points]
        kinds[ends] = END
        begins = self.scan.boundaries(kinds)
        if not len(ends):
            begins = begins[begins < len(kinds) - 1]  # of a text that goes on: behind the last certain boundary all is asked again
        raw = text.encode()
        at = begins
        if len(raw) > len(points):
            at = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)[begins]
        upto = [*at[1:].tolist(), len(raw)]
        own = kinds[begins] != END
        of_text = (np.cumsum(~own) - ~own)[own]
        slices = list(map(raw.__getitem__, map(slice, at[own].tolist(), np.array(upto)[own].tolist())))
        self.rest = len(text) - int(begins[-1]) if not len(ends) and len(begins) else 0
        return slices, of_text

    def _long(self, text: str) -> Iterator[list[bytes]]:
        """The slices of a long text, window by window: each begins where the last certain slice of the one before began."""
        at, width = 0, STEP
        while at + width < len(text):
            slices, _ = self._slices(text[at : at + width], np.empty(0, np.int64))
            if len(slices) > 1:
                at += width - self.rest
                yield slices[:-1]
                width = STEP
            else:
                width *= 2
        yield self._slices(text[at:] + "\n", np.array([len(text) - at]))[0]

    def _ids(self, slices: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of slices, and how many each has."""
        return self.table.ids_of(slices, self._merge)

    def _merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Slices that are tokens are these; others are merged, short ones together."""
        own = [self.ranks.get(x) for x in pieces]
        count, parts = np.ones(len(pieces), np.int64), []
        parts.append(([k for k, x in enumerate(own) if x is not None], np.array([x for x in own if x is not None], "<u4")))
        short = [k for k, x in enumerate(own) if x is None and len(pieces[k]) <= SHORT]
        if short:
            ids, n = merged([pieces[k] for k in short], self.single, self.pairs)
            count[short] = n
            parts.append((short, ids))
        for k in [k for k, x in enumerate(own) if x is None and len(pieces[k]) > SHORT]:
            ids = np.array(merged_long(pieces[k], self.ranks), "<u4")
            count[k] = len(ids)
            parts.append(([k], ids))
        out, begin = np.empty(count.sum(), "<u4"), np.cumsum(count) - count
        for k, ids in parts:
            n = count[k]
            out[np.repeat(begin[k] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return out, count

    def encode(self, texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each text its ids, and the offsets in its UTF-8 bytes at which they begin."""
        for part in _parts(texts):
            if len(part) == 1 and len(part[0]) > STEP:
                found = [self._ids(x)[0] for x in self._long(part[0])]
                yield self._with_offsets(np.concatenate(found))
                continue
            ends = np.cumsum([len(x) + 1 for x in part]) - 1
            slices, of_text = self._slices("\n".join(part) + "\n", ends)
            ids, count = self._ids(slices)
            upto = np.cumsum(np.bincount(of_text, count, len(part)).astype(np.int64))
            for k in range(len(part)):
                yield self._with_offsets(ids[upto[k - 1] if k else 0 : upto[k]])

    def _with_offsets(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.size_of[ids]
        return ids, np.cumsum(size) - size

    def decode(self, ids: np.ndarray, offsets: np.ndarray | None = None) -> bytes:
        """The bytes of ids, each put at its offset; without offsets one behind the other."""
        if not len(ids):
            return b""
        size = self.size_of[ids]
        if offsets is None:
            offsets = np.cumsum(size) - size
        source = np.repeat(self.begin[ids] - offsets, size) + np.arange(size.sum())
        return self.all_bytes[source].tobytes()


def _parts(texts: Iterable[str | None]) -> Iterator[list[str]]:
    """Texts in lots of at most STEP characters, a longer one alone; null counts as empty."""
    lot, size = [], 0
    for text in texts:
        text = text or ""
        if lot and size + len(text) > STEP:
            yield lot
            lot, size = [], 0
        lot.append(text)
        size += len(text)
    if lot:
        yield lot


def _worker(definition: str) -> ByteBPE:
    return worker_table(("byte", hash(definition)), lambda: ByteBPE(definition))


def _texts(column: pa.Array) -> list[str | None]:
    """Bytes that are no UTF-8 count as U+FFFD."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [None if x is None else x.decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


def _lots(column: pa.Array, most: int = 200) -> Iterator[tuple[int, list[str | None]]]:
    for k in range(0, len(column), most):
        yield k, _texts(column.slice(k, most))


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (array of int) and offsets (array of long: where each id begins in the text's UTF-8 bytes) of every document.

    Null and empty texts have no ids; rows without an id keep a null one; repeated rows give a row
    each; an empty table gives none. Long texts are worked on in windows of STEP characters. Columns
    other than id and text are not read, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_definition(docs.sparkSession, path))  # a tokenizer file, a few MB

    def run(batches):
        bpe = _worker(shared.value)
        for batch in batches:
            for k, texts in _lots(batch.column(1)):
                found = list(bpe.encode(texts))
                ids = pa.array([x for x, _ in found], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, len(texts)), ids, pa.array([x for _, x in found], pa.list_(pa.int64()))], ["id", "ids", "offsets"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string")).mapInArrow(run, "id long, ids array<int>, offsets array<long>")


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """id and bytes (binary) of what encoded() gives; ids that are null give no bytes, and null offsets stand for ids without gaps."""
    shared = tokens.sparkSession.sparkContext.broadcast(read_definition(tokens.sparkSession, path))

    def run(batches):
        bpe = _worker(shared.value)
        for batch in batches:
            rows = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            found = [bpe.decode(np.array(ids or [], np.int64), None if offsets is None else np.array(offsets, np.int64)) for ids, offsets in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["id", "bytes"])

    return tokens.select("id", "ids", "offsets").mapInArrow(run, "id long, bytes binary")


def round_trip_digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row, encoded and decoded within one task; the cases of encoded() hold."""
    shared = docs.sparkSession.sparkContext.broadcast(read_definition(docs.sparkSession, path))

    def run(batches):
        bpe = _worker(shared.value)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            for k, texts in _lots(batch.column(1)):
                rows = [(len(ids), sha(ids.tobytes()), sha(bpe.decode(ids, offsets))) for ids, offsets in bpe.encode(texts)]
                n, ids, back = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, len(texts)), pa.array(n, pa.int64()), pa.array(ids), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
