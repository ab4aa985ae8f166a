"""Byte-level BPE by ranks, centroid clustering and vector codes against brute force."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from punctual.llm import byte_bpe, centroids, vector_codes
from punctual.llm.queries import tokenizer_path
from punctual.llm.vectors import narrow, wide

PATH = tokenizer_path("byte_bpe_multi_50k.tiktoken")
ALPHABET = list("'''ssttrevelmd   \n\t\r  　\xa0aBé漢1٣Ⅷ.,!-_\U0001f600\x1c\x00́")
ODD = [None, "", " ", "  ", "\n", " \n x", "don't we'll they're 'tis 'R 'Re ''s  's\n's", "x'", "x'r", "x'l", "x'lll", "'v'e", "a" * 3000, " " * 3000, "b́" * 900, "漢字かな " * 700, "\U0001f600" * 50, "1234567 12 ٣٤", "<|endoftext|>", "end  \x85z"]


@pytest.fixture(scope="module")
def bpe():
    with open(PATH) as f:
        return byte_bpe.ByteBPE(f.read())


@pytest.fixture(scope="module")
def library(bpe):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


def _texts(n, most):
    draw = random.Random(5)
    return ["".join(draw.choice(ALPHABET) for _ in range(draw.randrange(most))) for _ in range(n)]


def test_encodes_as_the_library(bpe, library):
    texts = ODD + _texts(5000, 14)
    for text, (ids, offsets) in zip(texts, bpe.encode(texts), strict=True):
        raw = (text or "").encode()
        assert ids.tolist() == library.encode_ordinary(text or ""), text
        assert bpe.decode(ids, offsets) == bpe.decode(ids) == raw
        assert [raw[a : a + bpe.size_of[i]] for i, a in zip(ids, offsets, strict=True)] == [library.decode_single_token_bytes(i) for i in ids.tolist()]


def test_long_texts_in_windows(bpe, library, monkeypatch):
    """Windows of any size, and slices longer than one, give the same; so does merging with a heap, and a table that remembers little."""
    texts = ODD + _texts(300, 400)
    want = [library.encode_ordinary(x or "") for x in texts]
    for width, short, most in ((7, 64, 0), (50, 3, 20), (1 << 20, 1, 1 << 20)):
        monkeypatch.setattr(byte_bpe, "STEP", width)
        monkeypatch.setattr(byte_bpe, "SHORT", short)
        own = byte_bpe.ByteBPE.__new__(byte_bpe.ByteBPE)
        own.__dict__ |= bpe.__dict__ | {"table": byte_bpe.Slices(None, bpe.size_of, most)}
        for _ in range(2):
            assert [ids.tolist() for ids, _ in own.encode(texts)] == want
        assert len(own.table.number) <= most


def test_every_code_point_has_the_librarys_class():
    tokens = [bytes([k]) for k in range(256)] + [bytes([ord(x), k]) for x in "a1" for k in range(128, 256)]
    own = byte_bpe.ByteBPE("\n".join(f"{base64.b64encode(t).decode()} {k}" for k, t in enumerate(tokens)))
    library = tiktoken.Encoding("classes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    texts = [f"a{chr(c)} 1{chr(c)}\n{chr(c)}  " for c in range(128, 0x110000) if not 0xD800 <= c < 0xE000]
    assert all(ids.tolist() == library.encode_ordinary(x) for x, (ids, _) in zip(texts, own.encode(texts), strict=True))


def test_scan_is_the_automaton(bpe):
    """States by the associative scan are those of one step after the other."""
    kinds = np.random.default_rng(2).integers(0, 12, 20_000).astype(np.uint8)
    state, begins = byte_bpe.START, set()
    for k, kind in enumerate(kinds.tolist()):
        state, emitted = byte_bpe.step(state, kind)
        begins |= ({k} if emitted & byte_bpe.HERE else set()) | ({k - 1} if emitted & byte_bpe.BEFORE else set())
    assert bpe.scan.boundaries(kinds).tolist() == sorted(begins)


def test_ranks_must_have_all_bytes():
    with pytest.raises(ValueError, match="lack 255"):
        byte_bpe.ByteBPE(f"{base64.b64encode(b'a').decode()} 0")


def test_byte_bpe_queries(spark, library):
    rows = [(k, x) for k, x in enumerate(ODD)] + [(3, "x"), (3, "x"), (None, "null id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "ids", "offsets", "bytes", "n_tokens")})
    sha = lambda x: hashlib.sha256(x).hexdigest()
    ids = [library.encode_ordinary(x or "") for _, x in rows]
    want = [(k, len(i), sha(np.array(i, "<u4").tobytes()), sha((x or "").encode())) for (k, x), i in zip(rows, ids, strict=True)]
    assert sorted(map(str, byte_bpe.round_trip_digest(docs, PATH).collect())) == sorted(map(str, spark.createDataFrame(want, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string").collect()))
    tokens = byte_bpe.encoded(docs, PATH)
    assert sorted((str(r.id), bytes(r.bytes)) for r in byte_bpe.decoded(tokens, PATH).collect()) == sorted((str(k), (x or "").encode()) for k, x in rows)
    assert byte_bpe.encoded(docs.where("false"), PATH).count() == byte_bpe.round_trip_digest(docs.where("false"), PATH).count() == 0


def test_texts_that_are_no_utf8(spark, library):
    docs = spark.sql("SELECT 1L AS doc_id, cast(unhex('61FF62') AS string) AS text")
    assert byte_bpe.encoded(docs, PATH).first().ids == library.encode_ordinary("a�b")


VECTORS = 900


@pytest.fixture(scope="module")
def embeddings(spark):
    """Clusters, copies, vectors on a coarse grid (ties), unusable ones, repeated and null ids, null labels, extra columns."""
    rng = np.random.default_rng(7)
    rows = []
    for k in range(VECTORS):
        v = rng.normal(0, 0.2, 64) + (k % 9) / 4 if k % 3 else rng.integers(-2, 2, 64) / 8.0
        rows.append((k * 3 + 1, v.tolist(), None if k % 7 == 0 else k % 5))
    rows += [rows[5], rows[6], (None, rows[8][1], 3), (4, [9e5] * 64, 4), (9_001, None, 1), (9_002, [1.0] * 63, 1), (9_003, [1.0] * 65, 1), (9_004, [None] + [1.0] * 63, 1), (9_005, [float("nan")] + [1.0] * 63, 1), (9_006, [float("-inf")] + [1.0] * 63, 1), (9_007, [], 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit(1) for c in ("id", "v", "key", "_way", "chunk", "cluster", "code")}).repartition(5).persist()


def _whole(embeddings, scale):
    rows = [r for r in embeddings.select("vec_id", "embedding", "label").collect() if r.embedding and len(r.embedding) == 64 and all(x is not None and np.isfinite(x) for x in r.embedding)]
    x = np.clip(np.floor(np.array([r.embedding for r in rows]) * scale), -(1 << 27), 1 << 27).astype(np.int64)
    return rows, x


def _distances(x, c):
    return np.stack([((x - y) ** 2).sum(1) for y in c], 1)


def test_clusters(embeddings):
    rows, x = _whole(embeddings, 256)
    order = sorted((hashlib.sha256(f"2:{r.vec_id}".encode()).hexdigest(), r.embedding, k) for k, r in enumerate(rows) if r.vec_id is not None)
    c = x[[k for _, _, k in order[:40]]]
    for _ in range(5):
        a = _distances(x, c).argmin(1)
        for k in set(a.tolist()):
            c[k] = x[a == k].sum(0) // (a == k).sum()
    d = _distances(x, c)
    a = d.argmin(1)
    want = sorted(str((r.vec_id, int(k), int(e), int(d.min(1)[a == k].sum()), int(d.min(1).sum()), hashlib.sha256(",".join(map(str, c[k])).encode()).hexdigest())) for r, k, e in zip(rows, a, d.min(1), strict=True))
    for width in (64, 24):
        got = centroids.clustered(embeddings, width=width)
        assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
        assert sorted(str(tuple(r)) for r in got.collect()) == want


def test_codes(embeddings, monkeypatch):
    rows, x = _whole(embeddings, 1024)
    order = sorted((r.vec_id, r.embedding, k) for k, r in enumerate(rows) if r.vec_id is not None)
    first, cut = [k for _, _, k in order[:256]], [slice(16 * p, 16 * p + 16) for p in range(4)]
    books = [x[first][:, s] for s in cut]
    for n in range(5):
        d = [_distances(x[:, s], b) for s, b in zip(cut, books, strict=True)]
        for e, s, b in zip(d, cut, books, strict=True) if n < 4 else ():
            a = e.argmin(1)
            for k in set(a.tolist()):
                b[k] = x[a == k][:, s].sum(0) // (a == k).sum()
    error = sum(e.min(1) for e in d)
    by_label = {}
    for r, e in zip(rows, error.tolist(), strict=True):
        by_label[r.label] = by_label.get(r.label, 0) + e
    sha = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel()).encode()).hexdigest()
    want = sorted(str((r.vec_id, "".join(f"{e[k].argmin():02x}" for e in d), int(error[k]), by_label[r.label], sha)) for k, r in enumerate(rows))
    for most in (24, 1):
        monkeypatch.setattr(vector_codes, "MOST_NEAR", most)
        assert sorted(str(tuple(r)) for r in vector_codes.coded(embeddings).collect()) == want


def test_bounds_spare_distances_and_keep_ties():
    """Round by round the entries are those of a full search; ties go to the lower index; most parts of settled clusters are never compared."""
    rng = np.random.default_rng(1)
    for trial in range(30):
        n, k, w = rng.integers(1, 200), rng.integers(1, 40), rng.integers(1, 5)
        x = rng.integers(-4, 5, (n, w))
        book = x[rng.integers(0, n, k)].copy()
        bounds, near = vector_codes.fresh(x, book, 6), 6
        for _ in range(5):
            entry = _distances(x, book).argmin(1)
            assert (bounds.entry == entry).all(), trial
            after = book.copy()
            for j in set(entry.tolist()):
                after[j] = x[entry == j].sum(0) // (entry == j).sum()
            moved = np.nextafter(np.sqrt(((after - book) ** 2).sum(1).astype(float)), np.inf)
            book = after
            bounds, asks = vector_codes.advance(x, book, moved, vector_codes.Bounds.unpacked(bounds.packed()), max(near, 1))
            near -= 1
    centre = rng.integers(-3000, 3000, (64, 16))
    x = centre[rng.integers(0, 64, 4000)] + rng.integers(-20, 20, (4000, 16))
    bounds = vector_codes.fresh(x, centre, 8)
    _, asks = vector_codes.advance(x, centre + rng.integers(-2, 3, (64, 16)), np.full(64, 9.0), bounds, 8)
    assert asks[0] > 3990 and asks.sum() == 4000
    assert vector_codes._next_near(np.array([100, 90, 9, 1, 0, 0]), 4) == 2 and vector_codes._next_near(np.array([100, 0, 0, 0, 0, 0]), 4) == 2


def test_few_and_no_vectors(embeddings):
    for rows in (0, 3):
        some = embeddings.where("embedding is not null and size(embedding) = 64").limit(rows)
        assert centroids.clustered(some).count() == vector_codes.coded(some).count() == some.where("not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('inf'))").count()
    assert centroids.clustered(embeddings.where("size(embedding) <> 64")).columns == centroids.clustered(embeddings.limit(0)).columns
    assert vector_codes.coded(embeddings.limit(0)).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_numbers_in_narrow_bytes():
    for top in (3, 40_000, 1 << 40):
        values = np.array([[0, top], [-top, 1]])
        assert (wide(narrow(values), 2) == values).all()


def test_odd_characters_are_never_printable():
    """keys_of() looks for odd characters only in texts that are not printable but for line ends, and a mark of punctuation stands alone only behind a letter or digit."""
    from punctual.llm import pieces

    assert not any(chr(k).isprintable() for k in range(0x110000) if pieces._ODD.match(chr(k)))
    assert pieces.keys_of("Ab, (c). d.\né,") == ["\x00Ab", "\x00,", "(c).", "d", "\x00.", "\x00\n", "\x00é", "\x00,"]
