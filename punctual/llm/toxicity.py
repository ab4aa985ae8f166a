"""Toxicity: a factorization machine over hashed terms.

Terms are the distinct words of a text and the first PREFIX letters of longer ones,
hashed to BUCKETS. On a bounded sample of labelled documents the buckets that tell the labels apart are chosen, alone or
in a pair: a pair of terms that say nothing alone is found by its own counts. On these the machine learns a weight each and, through FACTORS
factors, a weight for every pair, so that two terms together can say more than their sum. Scoring visits each document once and moves no text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled documents to learn from at most, those with label 1 and those with 0, chosen by a hash of their id.
SAMPLE_TOXIC, SAMPLE_OTHER = 6_000, 12_000
BUCKETS, FACTORS, PREFIX = 1 << 20, 8, 5
#: A bucket is used if it occurs in LEAST_DOCS documents of the sample and either its share of toxic ones is LEAST_Z standard deviations from
#: chance, or that of a pair it makes is LEAST_PAIR_Z from what both of its buckets have alone. Pairs are tried of buckets in one document of PAIR_SHARE or more.
LEAST_DOCS, LEAST_Z, LEAST_PAIR_Z, PAIR_SHARE = 4, 4.0, 6.0, 50
#: The share of toxic documents with a bucket must also be so many times that of all, or so many times less: a large sample makes small differences significant.
LEAST_RATIO = 2.0
_TILE = 512
_WORD = re.compile(r"[^\W\d_]+")


def terms(text: str | None) -> set[int]:
    words = set(_WORD.findall((text or "").lower()))
    each = words | {w[:PREFIX] + "\u0000" for w in words if len(w) >= PREFIX}
    return {xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) % BUCKETS for w in each}


class Machine:
    """A weight and FACTORS factors for each of n terms. forward() takes rows as flat term numbers and row numbers."""

    def __init__(self, n: int, seed: int = 7):
        self.bias, self.w = 0.0, np.zeros(n)
        self.v = np.random.default_rng(seed).normal(0, 0.05, (n, FACTORS))

    def forward(self, flat: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the sigmoid, and each row's sum of factors."""
        own = self.v[flat]
        sums = np.stack([np.bincount(rows, own[:, f], n) for f in range(FACTORS)], axis=1)
        squares = np.bincount(rows, (own**2).sum(axis=1), n)
        return self.bias + np.bincount(rows, self.w[flat], n) + 0.5 * ((sums**2).sum(axis=1) - squares), sums

    def fit(self, flat: np.ndarray, rows: np.ndarray, labels: np.ndarray, steps: int = 250, rate: float = 0.05, l2: float = 1e-4) -> None:
        """Full-batch Adam on the logistic loss."""
        n, k = len(labels), len(self.w)
        self.bias = float(np.log((labels.sum() + 0.5) / (n - labels.sum() + 0.5)))
        values = [np.array([self.bias]), self.w, self.v]
        first, second = [np.zeros_like(x) for x in values], [np.zeros_like(x) for x in values]
        for step in range(1, steps + 1):
            score, sums = self.forward(flat, rows, n)
            error = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - labels) / n
            on = error[rows]
            dv = np.stack([np.bincount(flat, on * (sums[rows, f] - self.v[flat, f]), k) for f in range(FACTORS)], axis=1)
            grads = [np.array([error.sum()]), np.bincount(flat, on, k) + l2 * self.w, dv + l2 * self.v]
            for x, g, m, s in zip(values, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
            self.bias = float(values[0][0])


def _z(ones: np.ndarray, n: np.ndarray, p: np.ndarray | float) -> np.ndarray:
    return np.abs(ones - n * p) / np.sqrt(np.maximum(n * p * (1 - p), 1e-9))


def telling(flat: np.ndarray, rows: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The buckets to use, in order. flat: buckets, rows: the document of each, labels: of each document."""
    buckets, place = np.unique(flat, return_inverse=True)
    n, ones = np.bincount(place, minlength=len(buckets)), np.bincount(place, labels[rows], len(buckets))
    p = labels.mean() if len(labels) else 0.0
    far = (ones >= LEAST_RATIO * p * n) | (LEAST_RATIO * ones <= p * n)
    use = (n >= LEAST_DOCS) & (_z(ones, n, p) >= LEAST_Z) & far
    often = np.flatnonzero(n * PAIR_SHARE >= max(len(labels), LEAST_DOCS * PAIR_SHARE))  # PAIR_SHARE times a document's terms at most
    column = np.full(len(buckets), len(often))
    column[often] = np.arange(len(often))
    order = np.argsort(column[place], kind="stable")
    doc, border = rows[order], np.searchsorted(column[place][order], np.arange(len(often) + 1))
    tiles = range(0, len(often), _TILE)

    def tile(k: int) -> tuple[np.ndarray, np.ndarray]:
        """Which documents have the buckets of a tile, and the share of toxic ones of each bucket."""
        end = min(k + _TILE, len(often))
        has = np.zeros((len(labels), end - k), np.float32)
        has[doc[border[k] : border[end]], np.repeat(np.arange(end - k), np.diff(border[k : end + 1]))] = 1
        return has, ones[often[k:end]] / n[often[k:end]]

    for k in tiles:
        left, alone = tile(k)
        for j in tiles:
            right, other = (left, alone) if j == k else tile(j)
            both, bad = left.T @ right, left[labels == 1].T @ right[labels == 1]
            found = (both >= LEAST_DOCS) & (_z(bad, both, alone[:, None]) >= LEAST_PAIR_Z) & (_z(bad, both, other) >= LEAST_PAIR_Z)
            if j == k:
                np.fill_diagonal(found, False)
            use[often[k : k + _TILE]] |= found.any(axis=1)
    return buckets[use]


def sample(labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """The bounded training sample (id, label) of labels; where an id has both labels it counts as toxic."""
    own = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).alias("label"))
    by_hash = (F.xxhash64("id"), "id")
    return own.where("label = 1").orderBy(*by_hash).limit(SAMPLE_TOXIC).unionByName(own.where("label = 0").orderBy(*by_hash).limit(SAMPLE_OTHER))


def train(docs: DataFrame, sampled: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, Machine]:
    """The buckets used, in order, and the machine learnt from the documents of sampled (id, label), which is bounded; of rows that repeat an id one is learnt from."""

    def features(batches):
        for batch in batches:
            own = [np.array(sorted(terms(t)), "<i4").tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.binary())], ["id", "label", "terms"])

    chosen = F.broadcast(sampled)  # SAMPLE_TOXIC + SAMPLE_OTHER rows at most
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(chosen, "id").select("id", F.col("label").cast("int").alias("label"), "text")
    own = rows.mapInArrow(features, "id long, label int, terms binary").groupBy("id").agg(F.max("label").alias("label"), F.min("terms").alias("terms")).orderBy("id").collect()
    labels, each = np.array([x.label for x in own], float), [np.frombuffer(x.terms, "<i4") for x in own]
    flat = np.concatenate(each) if each else np.empty(0, np.int32)
    rows = np.repeat(np.arange(len(each), dtype=np.int32), [len(x) for x in each])
    del own, each
    buckets = telling(flat, rows, labels)
    machine = Machine(len(buckets))
    if len(buckets):
        place = np.minimum(np.searchsorted(buckets, flat), len(buckets) - 1)
        known = buckets[place] == flat
        place, rows = place[known], rows[known]
        machine.fit(place, rows, labels)
    return buckets, machine


def scored(docs: DataFrame, buckets: np.ndarray, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and score (0 to 1) of every row of docs; texts without known terms, empty and null ones too, get the machine's bias."""
    shared = docs.sparkSession.sparkContext.broadcast((buckets, machine))  # BUCKETS terms at most

    def run(batches):
        buckets, machine = shared.value
        number = np.full(BUCKETS, -1, np.int32)
        number[buckets] = np.arange(len(buckets))
        known: dict[str, tuple[int, ...]] = {}
        hashed = lambda t: int(number[xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) % BUCKETS])
        for batch in (part.slice(k, 500) for part in batches for k in range(0, part.num_rows, 500)):
            flat, sizes = [], []
            for text in batch.column(1).to_pylist():
                own: set[int] = set()
                for word in set(_WORD.findall((text or "").lower())):
                    got = known.get(word)
                    if got is None:
                        if len(known) > 400_000:
                            known.clear()
                        both = (hashed(word), hashed(word[:PREFIX] + "\u0000") if len(word) >= PREFIX else -1)
                        got = known[word] = tuple(x for x in both if x >= 0)
                    if got:
                        own.update(got)
                flat += own
                sizes.append(len(own))
            score = machine.forward(np.array(flat, np.int64), np.repeat(np.arange(len(sizes)), sizes), batch.num_rows)[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(score, -500, 500))))], [id_col, "score"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` long, score double")


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.7) -> DataFrame:
    """id_col, held_out, score, predicted for each row of docs. Labels of held-out ids (crc32 of the id as text, mod 3 = 1) are never read.

    Ids are whole numbers, others count as null. Without labels every score is the bias, one half. Extra columns are ignored; repeated rows
    give a row each; a null id is scored and not held out.
    """
    held = lambda c: F.coalesce(F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    buckets, machine = train(docs, sample(labels.where(~held(F.col(id_col))), id_col, label_col), id_col, text_col)
    out = scored(docs, buckets, machine, id_col, text_col)
    return out.select(id_col, held(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
