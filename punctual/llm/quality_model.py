"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text.

The model is over characters of order ORDER: a-z with accents taken off, digit, space, line end, mark, other sign, and
letters of all other scripts by their place in a row of 32, so that an alphabet's letters stay apart. A language with
LEAST trusted documents or more has a model and a threshold of its own; documents of the other languages share one model,
of all trusted text. The threshold of each is drawn to that of these languages together, the less the more held-out documents it has.

Texts are first packed into blocks of about BLOCK characters, each of one model. Tasks count a block's distinct n-grams
and deal them to shards by the two classes before the last. All orders from the third on of such an n-gram are in its shard, so
counts are joined there, and a shard answers what blocks ask of it; what the two lowest orders need is a
table of 4,096 entries a model. A shard's counts are merged in steps of at most FAN rows, and what is asked of it is
dealt to ways of about FAN blocks, so that no task holds more than its share whatever the size of the corpus.
One trusted document in CALIBRATION is not learnt from. A document is rejected if its perplexity is beyond the
quantile of these held-out documents of its language, with an allowance for sampling errors.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctual.llm.common import drop_stored, free_worker_tables, small_side, stored
from punctual.llm.token_files import pack, unpack

ORDER, CLASSES = 6, 64
#: Characters, and documents, after which a block is closed; a longer text is a block of its own.
BLOCK, BLOCK_DOCS = 1 << 23, 50_000
#: Characters that are worked on at once.
PIECE = 1 << 20
#: Shards of each model, and rows that are merged, or blocks that are answered, at once.
SHARDS, FAN = 64, 256
#: One trusted document in so many, by a hash of its id, sets the threshold instead of being learnt from.
CALIBRATION = 5
#: Trusted documents that a language needs for a model of its own.
LEAST = 100
#: Quantile of trusted perplexities, and allowance: a text of n characters may exceed it by the factor exp(ALLOWANCE / sqrt(n)).
QUANTILE, ALLOWANCE = 0.995, 2.0
#: The threshold from m held-out documents may be exceeded by the factor exp(SPREAD / sqrt(m)).
SPREAD = 1.0
#: Held-out documents that the quantile of a model weighs in that of each of its languages.
POOL_WEIGHT = 20
_BITS, _LOWEST = 6, 2
_MARKS = ".,;:!?'\"()-‘’“”«»¡¿"
_ALL = "all"


def _class_of(c: str) -> int:
    base = unicodedata.normalize("NFKD", c.lower())[:1]
    if c in "\n\r":
        return 0
    if c.isspace():
        return 1
    if "a" <= base <= "z":
        return 2 + ord(base) - ord("a")
    if c.isdigit():
        return 28
    if c in _MARKS:
        return 29
    return 32 + ord(c.lower()[:1]) % 32 if c.isalpha() or unicodedata.category(c)[0] == "M" else 30


@cache
def _table() -> np.ndarray:
    """Classes of the code points of the basic plane; those beyond count as letters, but for the symbols from U+1F000 to U+1FFFF."""
    return np.array([_class_of(chr(k)) for k in range(0x10000)], np.uint8)


def classes_of(text: str | None) -> np.ndarray:
    """Classes of ORDER - 1 line ends and of the text after them."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")
    own = _table()[np.minimum(points, 0xFFFF)]
    if len(points) and points.max() > 0xFFFF:
        own = np.where(points > 0xFFFF, np.where((points >= 0x1F000) & (points < 0x20000), 30, 32 + points % 32), own).astype(np.uint8)
    return np.concatenate([np.zeros(ORDER - 1, np.uint8), own])


def _pieces(packed: bytes, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """The n-grams of a block's documents, one after another, PIECE at a time; a document has as many as characters."""
    classes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    between = (np.cumsum(sizes + (ORDER - 1)) - (ORDER - 1))[:-1]
    between = (between[:, None] + np.arange(ORDER - 1)).ravel()
    n = len(classes) - ORDER + 1
    for begin in range(0, n, PIECE):
        end = min(n, begin + PIECE)
        code = np.zeros(end - begin, np.int64)
        for k in range(ORDER):
            np.left_shift(code, _BITS, out=code)
            np.bitwise_or(code, classes[begin + k : end + k], out=code)
        a, b = np.searchsorted(between, (begin, end))
        yield np.delete(code, between[a:b] - begin)


def _summed(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes, and the sums of their counts."""
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    first = np.flatnonzero(np.diff(code, prepend=-1))
    return code[first], np.add.reduceat(n, first) if len(first) else n


def _distinct(packed: bytes, sizes: np.ndarray) -> np.ndarray:
    return np.unique(np.concatenate([np.empty(0, np.int64), *map(np.unique, _pieces(packed, sizes))]))


def _middle(code: np.ndarray) -> np.ndarray:
    """The two classes before the last."""
    return (code >> _BITS) & 0xFFF


def _by_shard(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted distinct codes: their order by shard, middle classes and code, and the shards' borders in it."""
    middle = _middle(code)
    shard = ((middle * 40_503) >> 4) % SHARDS
    order = np.argsort((shard << 12 | middle).astype(np.uint32), kind="stable")
    return order, np.searchsorted(shard[order], np.arange(SHARDS + 1))


def _squeezed(code: np.ndarray) -> bytes:
    """Codes that are sorted by middle classes and then by themselves, as differences."""
    middle = _middle(code)
    rest = (code >> 3 * _BITS << _BITS) | (code & 63)
    first = np.flatnonzero(np.diff(middle, prepend=-1))
    step = np.diff(rest, prepend=0)
    step[first] = rest[first]
    sizes = np.diff(first, append=len(code))
    parts = [pack(x) for x in (middle[first], sizes, step)]
    head = np.array([len(first), len(code), *(len(y) for x in parts for y in x)], "<u4")
    return head.tobytes() + b"".join(y for x in parts for y in x)


def _spread(raw: bytes) -> np.ndarray:
    head = np.frombuffer(raw[:32], "<u4").tolist()
    at = np.cumsum([32, *head[2:]]).tolist()
    middle, sizes, step = (unpack(raw[at[2 * k] : at[2 * k + 1]], raw[at[2 * k + 1] : at[2 * k + 2]], n).astype(np.int64) for k, n in enumerate((head[0], head[0], head[1])))
    total = np.cumsum(step)
    first = np.cumsum(sizes) - sizes
    rest = total - np.repeat(total[first] - step[first], sizes)
    return rest >> _BITS << 3 * _BITS | np.repeat(middle, sizes) << _BITS | rest & 63


def _numbers(n: np.ndarray) -> bytes:
    """Counts: small ones take a byte."""
    low, large = np.minimum(n, 255).astype(np.uint8), n[n >= 255].astype("<i8")
    return np.array([len(n)], "<u4").tobytes() + low.tobytes() + large.tobytes()


def _counts(raw: bytes) -> np.ndarray:
    n = int(np.frombuffer(raw[:4], "<u4")[0])
    out = np.frombuffer(raw[4 : 4 + n], np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(raw[4 + n :], "<i8")
    return out


_PACKED = "block long, model string, ids array<long>, texts array<long>, langs array<string>, roles array<int>, sizes array<int>, packed binary"


def _packed(docs: DataFrame) -> DataFrame:
    """Blocks of docs (id, h, lang, model, role, text)."""

    def run(batches):
        free_worker_tables()
        long = zstandard.ZstdCompressionParameters.from_level(6, window_log=23, enable_ldm=True)
        press, waiting = zstandard.ZstdCompressor(compression_params=long), {}
        kinds = [pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]

        def row(model):
            ids, hashes, langs, roles, classes = zip(*waiting.pop(model)[0], strict=True)
            sizes = [len(x) - ORDER + 1 for x in classes]
            own = [[uuid.uuid4().int >> 65], [model], [ids], [hashes], [langs], [roles], [sizes], [press.compress(np.concatenate(classes).tobytes())]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(own, kinds, strict=True)], [x.split()[0] for x in _PACKED.split(", ")])

        for batch in batches:
            for k in range(batch.num_rows):
                i, h, lang, model, role, text = (c[k].as_py() for c in batch.columns)
                classes = classes_of(text)
                own, n = waiting.get(model, ([], 0))
                own.append((i, h, lang, role, classes))
                waiting[model] = own, n + len(classes)
                if n + len(classes) >= BLOCK or len(own) >= BLOCK_DOCS:
                    yield row(model)
        for model in list(waiting):
            yield row(model)

    return docs.select("id", "h", "lang", "model", "role", "text").mapInArrow(run, _PACKED)


def _learnt(blocks: DataFrame, ways: int, pooled: bool) -> DataFrame:
    """model, shard, way, codes, n: the n-grams of each block's documents to learn from. pooled: they count for the model of all text too."""

    def run(batches):
        for batch in batches:
            for block, model, roles, sizes, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if 1 not in roles:
                    continue
                sizes = np.array(sizes, np.int64)
                learnt, at, own = np.repeat(np.array(roles) == 1, sizes), 0, []
                for piece in _pieces(raw, sizes):
                    own.append(np.unique(piece[learnt[at : at + len(piece)]], return_counts=True))
                    at += len(piece)
                code, n = _summed(*(np.concatenate(x) for x in zip(*own, strict=True))) if own else (np.empty(0, np.int64),) * 2
                order, border = _by_shard(code)
                out = [(m, s, block % ways, _squeezed(code[x]), _numbers(n[x])) for s in range(SHARDS) if border[s] < border[s + 1] for x in [order[border[s] : border[s + 1]]] for m in ([model, _ALL] if pooled and model != _ALL else [model])]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["model", "shard", "way", "codes", "n"])

    return blocks.select("block", "model", "roles", "sizes", "packed").mapInArrow(run, "model string, shard int, way long, codes binary, n binary")


def _merged(rows: DataFrame, ways: int) -> DataFrame:
    """One row for each model and shard, from rows dealt to ways: in steps, of which none puts more than FAN rows together."""

    def merge(own: pa.Table) -> pa.Table:
        code = np.concatenate([_spread(x) for x in own["codes"].to_pylist()])
        n = np.concatenate([_counts(x) for x in own["n"].to_pylist()])
        code, n = _summed(code, n)
        by = np.argsort(_middle(code).astype(np.uint16), kind="stable")
        return pa.table({**{k: own[k].slice(0, 1) for k in ("model", "shard", "way")}, "codes": pa.array([_squeezed(code[by])], pa.binary()), "n": pa.array([_numbers(n[by])], pa.binary())})

    while True:
        rows = rows.groupBy("model", "shard", "way").applyInArrow(merge, "model string, shard int, way long, codes binary, n binary")
        if ways == 1:
            return rows.drop("way")
        ways = -(-ways // 16)  # the merged rows are larger
        rows = stored(rows.withColumn("way", F.pmod("way", F.lit(ways))), "merged")


def _discounts(n: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more from how many n-grams have counts 1 to 4: 0.5, 1 and 1.5 where these are lacking."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    return np.array([min(k, max(0.0, k - (k + 1) * y * n[k] / n[k - 1])) if n[0] and n[k - 1] else k / 2 for k in (1, 2, 3)])


def _orders(code: np.ndarray, n: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Sorted n-grams of each order from the third on with their counts: below the highest, of distinct n-grams that end in them."""
    levels = {ORDER: (code, n)}
    for k in range(ORDER - 1, _LOWEST, -1):
        levels[k] = np.unique(levels[k + 1][0] & ((1 << _BITS * k) - 1), return_counts=True)
    return levels


def _interpolated(n: np.ndarray, discount: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Probabilities of a dense table of counts, a row a context."""
    d = np.concatenate([[0.0], discount])[np.minimum(n, 3)]
    total = n.sum(axis=1, keepdims=True)
    return np.where(total > 0, (n - d + d.sum(axis=1, keepdims=True) * below) / np.maximum(total, 1), below)


def _low(shards: DataFrame) -> DataFrame:
    """model, low: the discounts of all orders, then the probabilities of order 2. A group is a model's SHARDS rows."""

    def of_shard(batches):
        for batch in batches:
            for model, codes, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                code = _spread(codes)
                order = np.argsort(code)
                levels = _orders(code[order], _counts(n)[order])
                some = [[int((x[1] == j).sum()) for j in (1, 2, 3, 4)] for k, x in sorted(levels.items())]
                two = np.bincount(levels[_LOWEST + 1][0] & 0xFFF, minlength=4096)
                yield pa.RecordBatch.from_arrays([pa.array([model]), pa.array([np.concatenate([np.ravel(some), two]).astype("<i8").tobytes()], pa.binary())], ["model", "sums"])

    def of_model(own: pa.Table) -> pa.Table:
        sums = np.sum([np.frombuffer(x, "<i8") for x in own["sums"].to_pylist()], axis=0)
        some, two = sums[: 4 * (ORDER - _LOWEST)].reshape(-1, 4), sums[4 * (ORDER - _LOWEST) :].reshape(CLASSES, CLASSES)
        one = (two > 0).sum(axis=0)
        d = [_discounts(np.array([(x == j).sum() for j in (1, 2, 3, 4)])) for x in (one, two)]
        p = _interpolated(two, d[1], _interpolated(one[None], d[0], np.full((1, CLASSES), 1 / CLASSES)))
        return pa.table({"model": own["model"].slice(0, 1), "low": pa.array([np.concatenate([*d, *(_discounts(x) for x in some), p.ravel()]).astype("<f8").tobytes()], pa.binary())})

    return shards.select("model", "codes", "n").mapInArrow(of_shard, "model string, sums binary").groupBy("model").applyInArrow(of_model, "model string, low binary")


def log_probabilities(asked: np.ndarray, code: np.ndarray, n: np.ndarray, low: bytes) -> np.ndarray:
    """Natural logarithms of the interpolated probabilities of asked n-grams, which are of one shard, as are the counts n of code."""
    values = np.frombuffer(low, "<f8")
    discounts, p = values[: 3 * ORDER].reshape(ORDER, 3), values[3 * ORDER :][asked & 0xFFF]
    order = np.argsort(code)
    for k, (gram, count) in sorted(_orders(code[order], n[order]).items()):
        if not len(gram):
            continue
        d = discounts[k - 1][np.minimum(count, 3) - 1]
        first = np.flatnonzero(np.diff(gram >> _BITS, prepend=-1))
        context, total, weight = gram[first] >> _BITS, np.add.reduceat(count, first), np.add.reduceat(d, first)
        own = asked & ((1 << _BITS * k) - 1)
        c = np.minimum(np.searchsorted(context, own >> _BITS), len(context) - 1)
        g = np.minimum(np.searchsorted(gram, own), len(gram) - 1)
        left = np.where(gram[g] == own, count[g] - d[g], 0.0)
        p = np.where(context[c] == own >> _BITS, (left + weight[c] * p) / total[c], p)
    return np.log(p)


def _answered(blocks: DataFrame, shards: DataFrame, low: DataFrame, ways: int) -> DataFrame:
    """block, shard, step, logp: for each block and shard the log probabilities of its distinct n-grams in order, in 16-bit steps of `step`."""

    def ask(batches):
        for batch in batches:
            for block, model, sizes, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                code = _distinct(raw, np.array(sizes, np.int64))
                order, border = _by_shard(code)
                out = [(block, model, s, block % ways, _squeezed(code[order[border[s] : border[s + 1]]])) for s in range(SHARDS) if border[s] < border[s + 1]]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["block", "model", "shard", "way", "codes"])

    def answer(asked: pa.Table, own: pa.Table) -> pa.Table:
        none = np.empty(0, np.int64)
        code, n = (_spread(own["codes"][0].as_py()), _counts(own["n"][0].as_py())) if own.num_rows and own["codes"][0].is_valid else (none, none)
        low = own["low"][0].as_py() if own.num_rows else None
        each = [_spread(x) for x in asked["codes"].to_pylist()]
        logp = -log_probabilities(np.concatenate(each), code, n, low) if low and each else np.full(sum(map(len, each)), np.log(CLASSES))
        steps, rows = [], []
        for x in np.split(logp, np.cumsum([len(x) for x in each])[:-1]) if each else []:
            steps.append(max(float(x.max()), 1e-9) / 65_535)
            rows.append(np.round(x / steps[-1]).astype("<u2").tobytes())
        return pa.table({"block": asked["block"], "shard": asked["shard"], "step": pa.array(steps, pa.float64()), "logp": pa.array(rows, pa.binary())})

    requests = blocks.select("block", "model", "sizes", "packed").mapInArrow(ask, "block long, model string, shard int, way long, codes binary")
    everywhere = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ways - 1).cast("long")))
    slots = low.crossJoin(low.sparkSession.range(SHARDS).select(F.col("id").cast("int").alias("shard")))  # SHARDS rows a model
    tables = slots.join(shards, ["model", "shard"], "left").withColumn("way", everywhere)
    return requests.groupBy("model", "shard", "way").cogroup(tables.groupBy("model", "shard", "way")).applyInArrow(answer, "block long, shard int, step double, logp binary")


def _scored(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """id, h, lang, model, role, n_chars, nll (mean negative log probability of a character; null without text) of the documents of blocks."""
    names = ["id", "h", "lang", "model", "role", "n_chars", "nll"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.float64()]

    def run(own: pa.Table, values: pa.Table) -> pa.Table:
        out = []
        found = {s: np.frombuffer(x, "<u2") * step for s, step, x in zip(*(values[c].to_pylist() for c in ("shard", "step", "logp")), strict=True)}
        for model, ids, hashes, langs, roles, sizes, packed in zip(*(own[c].to_pylist() for c in ("model", "ids", "texts", "langs", "roles", "sizes", "packed")), strict=True):
            sizes = np.array(sizes, np.int64)
            code = _distinct(packed, sizes)
            order, _ = _by_shard(code)
            logp = np.empty(len(code))
            logp[order] = np.concatenate([found[s] for s in sorted(found)]) if found else []
            ends, at = np.cumsum(sizes), 0
            total = np.zeros(len(sizes))
            for piece in _pieces(packed, sizes):
                # sums of the part of each document that lies in the piece
                first, last = np.searchsorted(ends, (at, at + len(piece) - 1), side="right")
                upto = np.concatenate([[0.0], np.cumsum(logp[np.searchsorted(code, piece)])])
                cut = np.clip(np.concatenate([ends[first : last + 1] - sizes[first : last + 1], [at + len(piece)]]) - at, 0, len(piece))
                total[first : last + 1] += np.diff(upto[cut])
                at += len(piece)
            nll = [float(t) / n if n else None for t, n in zip(total, sizes.tolist(), strict=True)]
            columns = [ids, hashes, langs, [model] * len(ids), roles, sizes, nll]
            out.append(pa.table([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names))
        return pa.concat_tables(out) if out else pa.table([pa.array([], t) for t in kinds], names)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, "id long, h long, lang string, model string, role int, n_chars long, nll double")


def held_out(id_col: str) -> Column:
    return F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(CALIBRATION)) == 0


def _text_key(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _judged(docs: DataFrame, trusted_ids: DataFrame, quantile: float, allowance: float, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    docs = docs.select(F.col(id_col).cast("long").alias("id"), _text_key(text_col).alias("h"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    trusted_ids = stored(trusted_ids.select(F.col(id_col).cast("long").alias("id")).where("id is not null").distinct().withColumn("own", F.when(held_out("id"), 2).otherwise(1)), "trusted")
    trusted = small_side(trusted_ids)
    langs = docs.select("id", "lang").where("lang is not null").join(trusted, "id", "left_semi").groupBy("lang").count().where(F.col("count") >= LEAST)
    langs = stored(langs.select("lang", F.concat(F.lit("="), "lang").alias("own_model")), "languages")
    roles = docs.join(trusted, "id", "left").join(small_side(langs), "lang", "left").withColumns({"role": F.coalesce("own", F.lit(0)), "model": F.coalesce("own_model", F.lit(_ALL))})
    blocks = stored(_packed(roles), "blocks")
    n_blocks, pooled = blocks.agg(F.count("*"), F.coalesce(F.bool_or(F.col("model") == _ALL), F.lit(False))).first()
    ways = max(1, -(-n_blocks // FAN))
    shards = stored(_merged(_learnt(blocks, ways, pooled), ways), "shards")
    low = stored(_low(shards), "low")
    scores = stored(_scored(blocks, _answered(blocks, shards, low, ways)), "scores")
    for x in (blocks, shards, low):
        drop_stored(x)
    apart, upper = scores.where("nll is not null and role = 2"), F.percentile_approx("nll", quantile, 10_000)
    pools = apart.groupBy("model").agg(upper.alias("pool"), F.count("*").alias("m"))
    owns = apart.where("lang is not null").groupBy("model", "lang").agg(upper.alias("own"), F.count("*").alias("n"))
    out = scores.join(small_side(stored(pools, "limits")), "model", "left").join(small_side(stored(owns, "language-limits")), ["model", "lang"], "left")
    shrunk = (F.col("n") * F.col("own") + POOL_WEIGHT * F.col("pool")) / (F.col("n") + POOL_WEIGHT)
    out = out.withColumn("limit", F.coalesce(shrunk, F.col("pool")) + SPREAD / F.sqrt("m"))
    kept = F.when(F.col("n_chars") == 0, False).otherwise(F.coalesce(F.col("nll") <= F.col("limit") + F.lit(allowance) / F.sqrt("n_chars"), F.lit(True)))
    return out.select(F.col("id").alias(id_col), "h", "lang", "n_chars", F.exp("nll").alias("perplexity"), F.exp("limit").alias("threshold"), kept.alias("kept"))


def judged(docs: DataFrame, trusted_ids: DataFrame, quantile: float = QUANTILE, allowance: float = ALLOWANCE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id_col, lang, n_chars, perplexity, threshold, kept for each row of docs.

    trusted_ids: id_col of the documents to learn from and to set thresholds by. Ids are whole numbers; others count as null. Languages with
    fewer than LEAST trusted documents, and a null language, are scored by the model of all trusted text; each has its own quantile, shrunk to that of all of
    them by POOL_WEIGHT held-out documents, and those without any, or null, have that of all. Texts without a character have no perplexity and are rejected. Where a model has no held-out trusted document there is no threshold: its documents
    are kept. Without any trusted text all n-grams are alike. Extra columns are ignored; repeated rows give a row each; a
    null id is scored, but never trusted. Log probabilities are rounded to 1/65,535 of the largest of a block's shard.
    """
    return _judged(docs, trusted_ids, quantile, allowance, id_col, text_col, lang_col).drop("h")


def filtered(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs that judged() keeps, with all their columns, row by row: the verdict on a row goes by its id, language and text, also where ids are null or repeated."""
    found = _judged(docs, trusted_ids, QUANTILE, ALLOWANCE, id_col, text_col, lang_col)
    mark = uuid.uuid4().hex  # names that docs doesn't have
    keys = [f"{x}_{mark}" for x in ("id", "h", "lang")]
    gone = stored(found.where("not kept").select(*[F.col(x).alias(k) for x, k in zip((id_col, "h", "lang"), keys, strict=True)]).distinct(), "rejected")
    same = F.col(keys[0]).eqNullSafe(F.col(id_col).cast("long")) & (F.col(keys[1]) == _text_key(text_col)) & F.col(keys[2]).eqNullSafe(F.col(lang_col))
    return docs.join(small_side(gone), same, "left_anti")
