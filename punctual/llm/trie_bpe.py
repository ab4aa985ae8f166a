"""BPE encoding by a prefix-sharing trie traversal, and decoding.

The BPE encoding of every prefix of a word ends in one token, and the tokens before
it are the encoding of the rest of that prefix. So one token a prefix, its last
one, says everything: the encoding of a word is read off by stepping back over
last tokens. For a prefix, the last token is that one among the vocabulary's
suffixes of the prefix which may follow the last token of what it leaves: two
tokens may stand side by side if encoding their joined bytes gives these two
again.

The distinct words of a batch form a trie. They are visited in sorted order, which is
the trie depth first, with the last tokens of the path on a stack; a prefix that
many words share is worked out once. Which tokens may stand side by side is
remembered for the life of a worker.
"""

from __future__ import annotations

import hashlib
import json
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punctual.llm.common import worker_table
from punctual.llm.pieces import Remembered, cut

#: Fixed value: the pattern by which byte-level BPE cuts texts into words.
WORD_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_REMEMBERED, _PAIRS = 700_000, 2_000_000


def byte_alphabet() -> dict[str, int]:
    """Printable Latin-1 characters stand for their own byte, the others are numbered from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class TrieBPE:
    """definition: the JSON text of a byte-level BPE tokenizer without normalizer."""

    def __init__(self, definition: str):
        own = json.loads(definition)
        if own["normalizer"] or own["pre_tokenizer"]["type"] != "ByteLevel" or own["pre_tokenizer"]["add_prefix_space"] or own["model"].get("ignore_merges"):
            raise ValueError("only plain byte-level BPE is supported")
        letters = byte_alphabet()
        raw = lambda t: bytes(letters[c] for c in t)
        self.id_of = {raw(t): i for t, i in own["model"]["vocab"].items() if all(c in letters for c in t)}
        self.bytes_of = {i: t for t, i in self.id_of.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in own["model"]["merges"]]
        self.rank = {(self.id_of[raw(a)], self.id_of[raw(b)]): (k, self.id_of[raw(a + b)]) for k, (a, b) in enumerate(pairs)}
        self.added = {x["content"]: x["id"] for x in own["added_tokens"]}
        for content, i in self.added.items():
            self.bytes_of[i] = content.encode()
            self.id_of.pop(content.encode(), None)
        self.longest = max(map(len, self.id_of))
        self.by_merging = {t: i for t, i in self.id_of.items() if self.merged(t) == [i]}
        self.pattern, self.special = regex.compile(WORD_PATTERN), regex.compile("|".join(map(regex.escape, self.added)) or r"(?!)")
        self.side_by_side: dict[int, bool] = {}
        self.known = Remembered(_REMEMBERED)

    def merged(self, word: bytes) -> list[int]:
        """Plain BPE: the merge learnt first is applied first, from left to right."""
        ids = [self.id_of[word[k : k + 1]] for k in range(len(word))]
        while len(ids) > 1:
            best = min((self.rank[p][0], k) for k, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.rank) if any(p in self.rank for p in zip(ids, ids[1:], strict=False)) else None
            if best is None:
                break
            k = best[1]
            ids[k : k + 2] = [self.rank[ids[k], ids[k + 1]][1]]
        return ids

    def may_follow(self, left: int, right: int) -> bool:
        key = left << 32 | right
        found = self.side_by_side.get(key)
        if found is None:
            if len(self.side_by_side) > _PAIRS:
                self.side_by_side.clear()
            found = self.side_by_side[key] = self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return found

    def encode_words(self, words: list[bytes]) -> dict[bytes, tuple[int, ...]]:
        """The encodings of distinct words."""
        out: dict[bytes, tuple[int, ...]] = {}
        last: list[int] = []  # last[k]: last token of the current word's first k + 1 bytes
        size = {i: len(t) for t, i in self.by_merging.items()}
        before, get, side, longest = b"", self.by_merging.get, self.side_by_side.get, self.longest
        for word in sorted(words):
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared:]
            for end in range(shared + 1, len(word) + 1):
                for begin in range(max(0, end - longest), end):
                    token = get(word[begin:end])
                    if token is not None:
                        if begin == 0:
                            break
                        left = last[begin - 1]
                        fits = side(left << 32 | token)
                        if self.may_follow(left, token) if fits is None else fits:
                            break
                last.append(token)
            ids, k = [], len(word)
            while k:
                ids.append(last[k - 1])
                k -= size[ids[-1]]
            out[word] = tuple(ids[::-1])
            before = word
        return out

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Token ids of whole texts; strings of added tokens become these tokens."""
        cuts: list[list[str | int]] = []
        for text in texts:
            own: list[str | int] = []
            at = 0
            for m in self.special.finditer(text or ""):
                own += [*(cut(text[at : m.start()]) if m.start() > at else []), self.added[m[0]]]
                at = m.end()
            cuts.append(own + (cut(text[at:]) if text[at:] else []) if own else cut(text or ""))
        known = self.known
        new = [p for p in known.unknown(cuts) if isinstance(p, str)]
        if new:
            split = {p: [w.encode("utf-8", "surrogatepass") for w in self.pattern.findall(p)] for p in new}
            ids = self.encode_words(list({w for ws in split.values() for w in ws}))
            for piece, own in split.items():
                known.add(piece, ids[own[0]] if len(own) == 1 else tuple(chain.from_iterable(map(ids.__getitem__, own))))
        return [list(chain.from_iterable(known[p] if isinstance(p, str) else (p,) for p in c) if any(isinstance(p, int) for p in c) else chain.from_iterable(map(known.__getitem__, c))) for c in cuts]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def _worker(definition: str) -> TrieBPE:
    return worker_table(("trie", hash(definition)), lambda: TrieBPE(definition))


def read_definition(spark: SparkSession, path: str) -> str:
    """The tokenizer file, a few MB at most, by any path that the driver or Spark can read."""
    try:
        with open(path, encoding="utf-8") as f:
            return f.read()
    except FileNotFoundError:
        return spark.read.text(path, wholetext=True).first().value


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ids (array of int) of every document. Null texts count as empty and have no ids."""
    shared = docs.sparkSession.sparkContext.broadcast(read_definition(docs.sparkSession, path))

    def run(batches):
        bpe = _worker(shared.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(bpe.encode(part.column(1).to_pylist()), pa.list_(pa.int32()))], ["id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).mapInArrow(run, "id long, ids array<int>")


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """id and text of what encoded() gives."""
    shared = tokens.sparkSession.sparkContext.broadcast(read_definition(tokens.sparkSession, path))

    def run(batches):
        bpe = _worker(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(bpe.decode, batch.column(1).to_pylist()), pa.string())], ["id", "text"])

    return tokens.select("id", "ids").mapInArrow(run, "id long, text string")


def round_trip_digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row, encoded and decoded within one task. Rows without an id keep a null one; repeated rows give a row each."""
    shared = docs.sparkSession.sparkContext.broadcast(read_definition(docs.sparkSession, path))

    def run(batches):
        bpe = _worker(shared.value)
        shown = {i: str(i) for i in bpe.bytes_of}
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                ids = bpe.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, ids), pa.int64()), pa.array(sha(",".join(map(shown.__getitem__, x))) for x in ids), pa.array(sha(bpe.decode(x)) for x in ids)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
