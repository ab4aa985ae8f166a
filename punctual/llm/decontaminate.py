"""Benchmark decontamination with an FM-index for each shard of the corpus.

The test phrases are windows of WINDOW benchmark words. A shard's text is a run of
documents as word numbers. Words and word pairs that occur in no phrase can't be part
of an occurrence, so a shard keeps the stretches between them alone, set apart by a
separator; nothing that could match is lost. Over that text the shard has a suffix
order, the Burrows-Wheeler text in a wavelet matrix, and sampled suffix positions.
All phrases are searched backwards at once through its ranks, occurrences are located
by walking to a sampled position, and their spans are merged.

A benchmark is a stated query set. It is cut to parts bounded in items and bytes, of which PARTS_AT_ONCE are broadcast; every shard is
searched for one of them after the other. A larger benchmark takes several passes over the documents: each pass's hits are stored and
its parts are given up before the next, so what a worker holds doesn't grow with the benchmark, and the number of parts changes no result.
"""

from __future__ import annotations

import uuid
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctual.llm.common import drop_stored, free_worker_tables, small_side, stored

WINDOW = 13
#: Benchmark items, and bytes of their texts, that are broadcast as one part; a longer item is a part by itself.
ITEMS_A_PASS, BYTES_A_PASS = 50_000, 4_000_000
#: Parts that stand broadcast at once.
PARTS_AT_ONCE = 2
_SHARD, _SAMPLE = 1_000_000, 8
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and all other code points from U+0080 on, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


class Phrases:
    """The distinct windows of benchmark items as arrays of word numbers from 1 on, and the items of each."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.number: dict[bytes, int] = {}
        rows: dict[int, list[tuple[np.ndarray, int]]] = {}
        self.names = sorted({item for item, _ in items})
        place = {item: k for k, item in enumerate(self.names)}
        for item, text in items:
            ids = np.array([self.number.setdefault(w, len(self.number) + 1) for w in words(text)], np.int64)
            if len(ids):
                n = min(window, len(ids))
                rows.setdefault(n, []).append((np.lib.stride_tricks.sliding_window_view(ids, n), place[item]))
        self.least, self.base = min(rows, default=0), len(self.number) + 1
        #: By length: the numbers of its windows' phrases, and the windows.
        self.by_length: list[tuple[int, np.ndarray, np.ndarray]] = []
        pairs, owners, n_phrases = [np.empty(0, np.int64)], [], 0
        for n, own in sorted(rows.items()):
            distinct, which = np.unique(np.concatenate([x for x, _ in own]), axis=0, return_inverse=True)
            self.by_length.append((n, np.arange(n_phrases, n_phrases + len(distinct)), distinct))
            owners.append(np.unique(np.stack([which.ravel() + n_phrases, np.repeat([k for _, k in own], [len(x) for x, _ in own])]), axis=1))
            pairs.append((distinct[:, :-1] * self.base + distinct[:, 1:]).ravel())
            n_phrases += len(distinct)
        self.pairs = np.unique(np.concatenate(pairs))
        #: The places of phrase k's items in names are owner[first[k] : first[k + 1]].
        both = np.concatenate(owners, axis=1) if owners else np.empty((2, 0), np.int64)
        self.owner, self.first = both[1], np.searchsorted(both[0], np.arange(n_phrases + 1))

    def items_of(self, phrase: int) -> list[str]:
        return [self.names[k] for k in self.owner[self.first[phrase] : self.first[phrase + 1]]]


class FMIndex:
    """text: word numbers from 1 on, 0 between stretches; the first and last entry is 0."""

    def __init__(self, text: np.ndarray, base: int):
        n = len(text)
        gap = text == 0
        rank = np.where(gap, np.cumsum(gap) - 1, text + n)  # each separator is of its own, so comparing ends there
        rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
        step = 1
        while rank.max() < n - 1:
            then = np.zeros(n, np.int64)
            then[:-step] = rank[step:] + 1
            rank = np.unique(rank * (n + 1) + then, return_inverse=True)[1].astype(np.int64)
            step *= 2
        order = np.empty(n, np.int64)
        order[rank] = np.arange(n)
        self.position = order
        bwt = text[order - 1]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=base))])
        self.sampled = (order % _SAMPLE == 0) | (bwt == 0)
        self.bwt, self.levels, level = bwt, [], bwt
        for shift in range(max(1, int(base - 1).bit_length()) - 1, -1, -1):
            bit = (level >> shift) & 1
            self.levels.append((shift, np.concatenate([[0], np.cumsum(bit)]), int(n - bit.sum())))
            level = np.concatenate([level[bit == 0], level[bit == 1]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often symbol occurs in the first `end` entries of the Burrows-Wheeler text."""
        begin, end = np.zeros_like(end), end
        for shift, ones, zeros in self.levels:
            bit = (symbol >> shift) & 1
            begin, end = (np.where(bit == 1, zeros + ones[x], x - ones[x]) for x in (begin, end))
        return end - begin

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of rows, one for each phrase (a row of word numbers)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.bwt), np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[:, k]
            low, high = self.start[symbol] + self.rank(symbol, low), self.start[symbol] + self.rank(symbol, high)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        rows, steps, todo = rows.copy(), np.zeros(len(rows), np.int64), np.arange(len(rows))
        while len(todo := todo[~self.sampled[rows[todo]]]):
            symbol = self.bwt[rows[todo]]
            rows[todo] = self.start[symbol] + self.rank(symbol, rows[todo])
            steps[todo] += 1
        return self.position[rows] + steps


def _stretches(ids: np.ndarray, phrases: Phrases) -> np.ndarray:
    """Places of words in stretches long enough for the shortest phrase, all of whose word pairs occur in phrases."""
    if phrases.least == 1:
        return np.flatnonzero(ids)
    at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
    if len(at) < phrases.least - 1:
        return at[:0]
    code = ids[at] * phrases.base + ids[at + 1]
    at = at[phrases.pairs[np.minimum(np.searchsorted(phrases.pairs, code), len(phrases.pairs) - 1)] == code]
    if len(at) < phrases.least - 1:
        return at[:0]
    first = np.flatnonzero(np.diff(at, prepend=at[0] - 2) > 1)
    count = np.diff(first, append=len(at))
    long = count >= phrases.least - 1
    first, count = at[first[long]], count[long] + 1
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())


def _shard_hits(text: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all occurrences: position in text, length and phrase."""
    index = FMIndex(text, phrases.base)
    found = []
    for length, which, rows in phrases.by_length:
        low, high = index.search(rows)
        count = np.maximum(0, high - low)
        hit = np.repeat(np.arange(len(rows)), count)
        row = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + low[hit]
        found.append((index.locate(row), np.full(len(row), length), which[hit]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _kept(own: list[bytes], phrases: Phrases) -> tuple[np.ndarray, np.ndarray] | None:
    """What a shard keeps of a document: its stretches as word numbers with a 0 before, between and after them, and their places; None if there are none."""
    if not len(own) >= phrases.least > 0:
        return None
    ids = np.fromiter(map(phrases.number.get, own, repeat(0)), np.int64, len(own))
    kept = _stretches(ids, phrases)
    if not len(kept):
        return None
    gaps = np.concatenate([[0], np.cumsum(np.diff(kept) > 1)]) + np.arange(len(kept)) + 1
    text, place = np.zeros(gaps[-1] + 2, np.int64), np.zeros(gaps[-1] + 2, np.int64)
    text[gaps], place[gaps] = ids[kept], kept
    return text, place


def _found(own: list[tuple[int, np.ndarray, np.ndarray]], phrases: Phrases, merged: list, items: list[set[str]]) -> None:
    """Adds the hit spans of a shard's documents, as [begin, end) word positions, and the items. own: numbers of documents and what is kept of them."""
    if not own:
        return
    text, place = (np.concatenate([x[k] for x in own]) for k in (1, 2))
    doc = np.repeat([k for k, _, _ in own], [len(x) for _, x, _ in own])
    at, length, phrase = _shard_hits(text, phrases)
    mark = np.zeros(len(text) + 1, np.int64)
    np.add.at(mark, at, 1)
    np.add.at(mark, at + length, -1)
    edge = np.diff(np.concatenate([[0], (np.cumsum(mark[:-1]) > 0).astype(np.int8), [0]]))
    for b, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
        merged[doc[b]].append([int(place[b]), int(place[b]) + e - b])
    for d, p in np.unique(np.stack([doc[at], phrase]), axis=1).T.tolist():
        items[d].update(phrases.items_of(p))


def _union(spans: list[list[int]]) -> list[list[int]]:
    """Spans in order, those that overlap or touch made one."""
    out: list[list[int]] = []
    for b, e in sorted(spans):
        if out and b <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([b, e])
    return out


_HITS = "id long, h long, n_words long, spans array<array<bigint>>, items array<string>"


def _joined(batches):
    """A mapInArrow function over hits whose spans and items come from several passes: each list in order, spans that overlap or touch made one."""
    for batch in batches:
        merged, items = [_union(x) for x in batch.column(3).to_pylist()], [sorted(set(x)) for x in batch.column(4).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(merged, pa.list_(pa.list_(pa.int64()))), pa.array(items, pa.list_(pa.string()))], ["id", "h", "n_words", "spans", "items"])


def _search(parts: list):
    """A mapInArrow function over (id, h, text): per document n_words, the merged hit spans as word positions, and the items. parts: broadcast phrases."""

    def flush(ids, hashes, sizes, kept):
        merged: list[list[list[int]]] = [[] for _ in ids]
        items: list[set[str]] = [set() for _ in ids]
        for part, own in zip(parts, kept, strict=True):
            _found(own, part.value, merged, items)
        if len(parts) > 1:
            merged = [_union(x) for x in merged]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(merged, pa.list_(pa.list_(pa.int64()))), pa.array([sorted(x) for x in items], pa.list_(pa.string()))], ["id", "h", "n_words", "spans", "items"])

    def run(batches):
        free_worker_tables()
        new = lambda: ([], [], [], [[] for _ in parts])
        shard, size = new(), 0
        for batch in batches:
            for k in range(batch.num_rows):  # one text at a time: of its words only the kept stretches stay
                i, h, text = (c[k].as_py() for c in batch.columns)
                own = words(text)
                for part, kept in zip(parts, shard[3], strict=True):
                    if found := _kept(own, part.value):
                        kept.append((len(shard[0]), *found))
                for column, value in zip(shard, (i, h, len(own)), strict=False):
                    column.append(value)
                size += len(own)
                if size >= _SHARD or len(shard[0]) >= 20_000:
                    yield flush(*shard)
                    shard, size = new(), 0
        if shard[0]:
            yield flush(*shard)

    return run


def _hits(docs: DataFrame, benchmark: DataFrame, window: int, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    docs = docs.select(F.col(id_col).cast("long").alias("id"), _text_key(text_col).alias("h"), F.col(text_col).alias("text"))
    asked = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).where("item is not null")
    n, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n_parts = max(1, -(-n // ITEMS_A_PASS), -(-size // BYTES_A_PASS))
    if n_parts > PARTS_AT_ONCE:
        asked = stored(asked, "benchmark")

    def searched(first: int) -> tuple[DataFrame, list]:
        """The hits of PARTS_AT_ONCE parts from the first on, and these parts."""
        parts = []
        for k in range(first, min(first + PARTS_AT_ONCE, n_parts)):
            own = asked.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_parts)) == k) if n_parts > 1 else asked
            parts.append(docs.sparkSession.sparkContext.broadcast(Phrases([(x.item, x.text) for x in own.collect()], window)))
        return docs.mapInArrow(_search(parts), _HITS), parts

    if n_parts <= PARTS_AT_ONCE:
        return searched(0)[0]
    passes = []
    for first in range(0, n_parts, PARTS_AT_ONCE):
        found, parts = searched(first)
        passes.append(stored(found if not first else found.where(F.size("items") > 0).distinct(), "hits"))  # all rows stand in the first
        for x in parts:
            x.destroy()
    drop_stored(asked)
    more = reduce(DataFrame.unionByName, passes[1:]).groupBy(F.col("id").alias("_id"), F.col("h").alias("_h"))  # a row a pass at most
    more = stored(more.agg(F.flatten(F.collect_list("spans")).alias("_spans"), F.flatten(F.collect_list("items")).alias("_items")), "more-hits")
    for x in passes[1:]:
        drop_stored(x)
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))
    none = F.array()
    both = passes[0].join(small_side(more), same, "left").select("id", "h", "n_words", F.concat("spans", F.coalesce("_spans", none)).alias("spans"), F.concat("items", F.coalesce("_items", none)).alias("items"))
    return both.mapInArrow(_joined, _HITS)


def _text_key(text_col: str):
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """id, n_words, spans (merged [begin, end) word positions), items of every row of docs, repeated rows too.

    Ids of docs are whole numbers, others become null. Null texts and texts without words have no hits; items without words have no phrases.
    An empty benchmark leaves every document clean.
    """
    return _hits(docs, benchmark, window, id_col, text_col, item_col, item_text_col).drop("h")


def _verdicts(found: DataFrame) -> DataFrame:
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    found = found.withColumn("n_hit", n_hit).withColumn("n_items", F.size("items").cast("long")).withColumn("items_sha256", F.sha2(F.array_join(F.array_sort("items"), ","), 256))
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))


def judged(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """hits() with the digest columns: n_hit, n_items, items_sha256, contaminated (5 % of the words are hit)."""
    return _verdicts(hits(docs, benchmark, window, id_col, text_col)).withColumnRenamed("id", id_col)


def cleaned(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs that are not contaminated, with all their columns. The verdict on a row goes by its id and text, also where ids are null or repeated."""
    found = _verdicts(_hits(docs, benchmark, window, id_col, text_col, "item_id", "text")).where("contaminated")
    mark = uuid.uuid4().hex  # names that docs doesn't have
    gone = stored(found.select(F.col("id").alias(f"id_{mark}"), F.col("h").alias(f"h_{mark}")).distinct(), "contaminated")
    same = F.col(f"id_{mark}").eqNullSafe(F.col(id_col).cast("long")) & (F.col(f"h_{mark}") == _text_key(text_col))
    return docs.join(small_side(gone), same, "left_anti")
