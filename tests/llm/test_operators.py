"""Each operator against a brute-force version on a small table with nulls, empty, long, repeated and odd texts."""

import base64
import hashlib
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from punctual.llm import common, decontaminate, near_dups, pii, quality_model, quality_rules, token_files, toxicity, trie_bpe, url_filter, warc
from punctual.llm.common import new_path
from punctual.llm.pieces import cut
from punctual.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "one", "one two", "ONE two", "a\n\n a  b\t\x0bc", "x\u00a0y é\u2028z", "x\n <|endoftext|> b", "same line\nsame line\n\n", "a b c a b c a b c", "1.2.3.4 256.1.1.1 1.2.3.4.5", "a@b.c%d_x@y.zz @ a@b", "+1 (555) 123-4567 +12", "4111 1111 1111 1111 4111-1111-1111-1112", "9" * 5000, "a.b@" + "c." * 5000 + "d", "w " * 30_000, "\U0001f600 mail q@w.er \U0001f600 +49 30 1234567"]


@pytest.fixture(scope="module")
def docs(spark):
    """The small documents table, odd texts behind it, two rows of them repeated, and extra columns with clashing names."""
    own = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(10_000 + k, t, None) for k, t in enumerate(ODD)] + [(10_004, "one two", None)] * 2, "doc_id long, text string, lang string")
    extra = {c: F.lit(1) for c in ("id", "key", "n_words", "kept", "term", "email", "value", "score", "component", "spans")}
    return own.unionByName(odd).withColumns(extra).persist()


@pytest.fixture(scope="module")
def rows(docs):
    return [(x.doc_id, x.text) for x in docs.select("doc_id", "text").collect()]


def _empty(docs):
    return docs.where("false")


def test_quality_rules(docs, rows):
    got = {x.doc_id: x for x in quality_rules.judged(docs.drop("n_words", "kept")).collect()}
    for doc_id, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        wins = Counter(zip(w, w[1:], w[2:], strict=False))
        again = {k + j for k in range(len(w) - 2) for j in range(3) if wins[tuple(w[k : k + 3])] > 1}
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        x = got[doc_id]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again)), doc_id
        assert x.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w))
        assert not (x.base_failed and x.kept)
    assert quality_rules.judged(docs).count() == len(rows)
    assert quality_rules.judged(_empty(docs)).count() == 0


def test_rules_are_ordered_by_worth(docs):
    none = quality_rules.Rule("none", F.length("text") < 0)
    names = lambda: [r.name for r in quality_rules.ordered_rules(docs, [none, *quality_rules.standard_rules()])]
    order = names()
    assert order.index("few_words") < order.index("repeated_windows") and order.index("few_words") < order.index("none") and len(order) == 7
    assert quality_rules.cascade(docs, [], quality_rules.from_text()).where("rejected_by is not null").count() == 0


def test_cascade_is_short_circuit(docs):
    """A rule behind one that rejects a row is not worked out on it; verdicts are those of judged()."""
    trap = quality_rules.Rule("trap", lambda m: F.when(m("n_words") < 50, F.raise_error(F.lit("asked"))).otherwise(False))
    rules = [quality_rules.standard_rules()[0], trap]
    assert quality_rules.cascade(docs, rules, quality_rules.from_text()).where("rejected_by = 'few_words'").count() > 0
    lazy = {(x.doc_id, x.kept) for x in quality_rules.filtered(docs).select("doc_id", "kept").collect()}
    assert lazy == {(x.doc_id, x.kept) for x in quality_rules.judged(docs).select("doc_id", "kept").collect()}
    extra = docs.withColumns({"_words": F.lit(1), "_lines": F.lit(2)})
    assert {"_words", "_lines"} <= set(quality_rules.judged(extra).columns)


def test_warc(spark):
    trap = "<p>WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n</p>"
    html = [None, "", "", "a", "a", "b" * 5000, trap, trap + "x", "é\r\n\r\nWARC/1.1\r\n", "WARC/1.1\r\n" * 50] + [f"<p>{k}</p>" * (k % 7) for k in range(200)]
    pages = spark.createDataFrame([(k, f"http://h/{k}" if k else None, t) for k, t in enumerate(html)], "page_id long, url string, html string").withColumn("file", F.lit("x")).repartition(3)
    path = new_path(spark, "warc")
    warc.write_archives(pages, path)
    payloads = [(t or "").encode() for t in html]
    first = {}
    want = set()
    for k, p in enumerate(payloads):
        one = first.setdefault(p, k)
        want.add((k, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if one == k else "revisit", None if one == k else one))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("128m", "700"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        assert {tuple(x) for x in warc.digest(warc.read_archives(spark, path)).collect()} == want
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    path = new_path(spark, "warc")
    warc.write_archives(pages, path, min_bytes=2)
    assert warc.read_archives(spark, path).where("record_type = 'revisit' and payload_bytes > 0").count() == 0


def test_warc_long_urls(spark):
    urls = ["http://h/0", "data:text/html," + "x" * 100_000, "http://h/2", "data:text/html," + "y" * 3_000_000, "http://h/4"]
    pages = spark.createDataFrame([(k, u, f"<p>{k}</p>") for k, u in enumerate(urls)], "page_id long, url string, html string").coalesce(1)
    path = new_path(spark, "warc")
    warc.write_archives(pages, path)
    assert sorted((x.record_id, x.url, x.payload_bytes) for x in warc.read_archives(spark, path).collect()) == [(f"<urn:page:{k}>", u, 8) for k, u in enumerate(urls)]


def test_url_filter(spark):
    urls = [None, "", "nothing", "http://A.Org", "http://a.org/x", "https://example.org/es/1", "https://s.EXAMPLE.org/en/19?x", "https://s.example.org/en/2", "http://b.com/fr/1", "http://b.com/de/1", "http://bad.net/1#x://y", "http://good.net", "x://y/://z"]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls + ["http://bad.net/2"] * 40 + ["http://good.net/2"] * 400)], "page_id long, url string").withColumn("host", F.lit(1))
    outcomes = pages.where("url like '%.net/2'").select("page_id", F.col("url").contains("bad").cast("int").alias("bad"))
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in url_filter.judged(pages, outcomes).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.org", "", None, "allow") and got[4] == ("a.org", "/x", "org/", "allow")
    assert got[5] == ("example.org", "/es/1", "example.org/es/", "block") and got[6] == ("s.example.org", "/en/19", "example.org/en/1", "block") and got[7][2] == "org/"
    assert got[8][2:] == ("com/fr/", "allow") and got[9][2:] == ("com/de/", "block")
    assert got[10] == ("bad.net", "/1", None, "block") and got[11] == ("good.net", "", None, "allow") and got[12][:2] == ("y", "/://z")
    assert url_filter.judged(pages.where("false"), outcomes).count() == 0
    assert url_filter.judged(pages, outcomes.where("false")).where("verdict = 'block' and rule is null").count() == 0


def _kneser_ney(texts):
    """Plain dictionaries: interpolated modified Kneser-Ney over class strings."""
    order = quality_model.ORDER
    counts = {order: Counter()}
    for t in texts:
        classes = quality_model.classes_of(t).tolist()
        counts[order].update(tuple(classes[k : k + order]) for k in range(len(classes) - order + 1))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    disc, ctx = {}, {}
    for k, own in counts.items():
        n = [0, *(sum(v == j for v in own.values()) for j in (1, 2, 3, 4))]
        y = n[1] / (n[1] + 2 * n[2])
        disc[k] = [0, *(min(j, max(0.0, j - (j + 1) * y * n[j + 1] / n[j])) if n[j] and n[1] else j / 2 for j in (1, 2, 3))]
        ctx[k] = defaultdict(lambda: [0, 0.0])
        for g, v in own.items():
            ctx[k][g[:-1]][0] += v
            ctx[k][g[:-1]][1] += disc[k][min(v, 3)]

    def p(g):
        if not g:
            return 1 / quality_model.CLASSES
        k, lower = len(g), p(g[1:])
        if g[:-1] not in ctx[k]:
            return lower
        total, gamma = ctx[k][g[:-1]]
        v = counts[k].get(g, 0)
        return (v - disc[k][min(v, 3)]) / total + gamma / total * lower

    return p


@pytest.mark.parametrize(("least", "fan"), [(20, 256), (100, 2)])
def test_quality_model(spark, docs, rows, monkeypatch, least, fan):
    """Every perplexity, threshold and verdict against plain dictionaries, with models by language and with one of all, merged at once and in steps."""
    monkeypatch.setattr(quality_model, "LEAST", least)
    monkeypatch.setattr(quality_model, "FAN", fan)
    monkeypatch.setattr(quality_model, "PIECE", 1 << 20 if fan > 2 else 1000)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    trusted = labels.where("quality = 1").select("doc_id")
    found = quality_model.judged(docs, trusted).collect()
    assert len(found) == len(rows)
    got = {x.doc_id: x for x in found}
    good = {x.doc_id for x in trusted.collect()}
    langs = {x.doc_id: x.lang for x in docs.select("doc_id", "lang").collect()}
    apart = {x.doc_id for x in trusted.where(quality_model.held_out("doc_id")).collect()}
    many = {k for k, n in Counter(langs[d] for d in good if d in langs and langs[d]).items() if n >= least}
    model_of = {d: langs[d] if langs[d] in many else None for d in langs}
    assert bool(many) == (least == 20)
    nll, order = {}, quality_model.ORDER
    for model in set(model_of.values()):
        p = _kneser_ney([t for d, t in rows if d in good - apart and (model is None or model_of[d] == model)])
        known = {}
        for d, t in rows:
            if model_of[d] == model and t and len(t) < 6000:
                classes = quality_model.classes_of(t).tolist()
                grams = [tuple(classes[k : k + order]) for k in range(len(t))]
                for g in grams:
                    if g not in known:
                        known[g] = -math.log(p(g))
                nll[d] = sum(map(known.__getitem__, grams)) / len(t)
                assert math.isclose(math.log(got[d].perplexity), nll[d], abs_tol=3e-4), d
    upper = lambda x: x[math.ceil(quality_model.QUANTILE * len(x)) - 1]
    for model in set(model_of.values()):
        apart_of = defaultdict(list)
        for d in apart & set(got):
            if model_of[d] == model:
                apart_of[langs[d]].append(math.log(got[d].perplexity))
        pool = sorted(x for own in apart_of.values() for x in own)
        for d in (d for d in got if model_of[d] == model):
            assert (got[d].threshold is None) == (not pool)
            if pool:
                own, weight = sorted(apart_of.get(langs[d], []) if langs[d] else []), quality_model.POOL_WEIGHT
                limit = (len(own) * upper(own) + weight * upper(pool)) / (len(own) + weight) if own else upper(pool)
                limit += quality_model.SPREAD / math.sqrt(len(pool))
                assert math.isclose(math.log(got[d].threshold), limit, abs_tol=1e-6)
                if got[d].n_chars:
                    assert got[d].kept == (math.log(got[d].perplexity) <= limit + quality_model.ALLOWANCE / math.sqrt(got[d].n_chars))
    assert not got[10_000].kept and not got[10_001].kept and got[10_000].perplexity is None
    judged = [(got[x.doc_id].kept, x.quality) for x in labels.collect() if x.doc_id in got]
    assert sum(k for k, q in judged if q) >= 0.97 * sum(q for _, q in judged)
    assert sum(not k for k, q in judged if not q) >= (0.5 if many else 0.3) * sum(not q for _, q in judged)


def test_quality_thresholds_by_language(spark):
    """Languages of 3, 30 and 300 trusted documents, one without any and rows without one: the fewer held-out documents, the nearer the threshold of all."""
    import random

    draw, letters = random.Random(11), {"a": "aeio", "b": "bcdfghkl", "c": "mnprstvwxzaeiou", "d": "uy"}
    rows, trusted = [], []
    for lang, n in (("a", 3), ("b", 30), ("c", 300), ("d", 0), (None, 0)):
        for k in range(max(n, 5)):
            rows.append((len(rows), "".join(draw.choice(letters[lang or "c"] + " ") for _ in range(200)), lang))
            if k < n:
                trusted.append((rows[-1][0],))
    own = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    good = spark.createDataFrame(trusted, "doc_id long")
    found = quality_model.judged(own, good).collect()
    limit = {x.lang: x.threshold for x in found}
    assert len(found) == len(rows) and limit["d"] == limit[None]
    apart = {x.doc_id for x in good.where(quality_model.held_out("doc_id")).collect()}
    shared = [x for x in found if x.doc_id in apart and x.lang in ("a", "b")]
    pool = max(math.log(x.perplexity) for x in shared)
    for lang in "ab":
        own_nll = [math.log(x.perplexity) for x in shared if x.lang == lang]
        expected = pool if not own_nll else (len(own_nll) * max(own_nll) + quality_model.POOL_WEIGHT * pool) / (len(own_nll) + quality_model.POOL_WEIGHT)
        assert math.isclose(math.log(limit[lang]), expected + quality_model.SPREAD / math.sqrt(len(shared)), abs_tol=1e-6)
    large = sorted(math.log(x.perplexity) for x in found if x.doc_id in apart and x.lang == "c")
    assert math.isclose(math.log(limit["c"]), large[math.ceil(quality_model.QUANTILE * len(large)) - 1] + quality_model.SPREAD / math.sqrt(len(large)), abs_tol=1e-6)
    assert all(x.kept for x in found if (x.doc_id,) in set(trusted))


def test_quality_model_without_rows(docs, spark):
    trusted = docs.select("doc_id").where("doc_id < 200")
    assert quality_model.judged(_empty(docs), trusted).count() == 0
    assert quality_model.judged(docs, trusted.where("false")).where("n_chars > 0 and (not kept or perplexity is null)").count() == 0


def test_quality_model_knows_scripts(spark):
    import random

    draw = random.Random(5)
    of = [["слово", "книга", "город", "время", "дорога", "человек"], ["λόγος", "βιβλίο", "πόλη", "χρόνος", "δρόμος", "άνθρωπος"]]
    rows = [(k, " ".join(draw.choice(of[k % 2]) for _ in range(60)), "xy"[k % 2]) for k in range(400)]
    rows += [(1000 + k, "".join(draw.choice("жщъыэюфхцч ") for _ in range(300)), "x") for k in range(20)] + [(2000, rows[1][1], "x")]
    own = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in quality_model.judged(own, own.where("doc_id < 1000").select("doc_id")).collect()}
    assert all(got[k].kept for k in range(400)) and not any(got[1000 + k].kept for k in range(20)) and not got[2000].kept


def test_quality_filter_goes_by_row(spark):
    text = "the same plain words stand in every one of these trusted documents"
    rows = [(k, text) for k in range(200)] + [(500, text), (500, ""), (None, text), (None, ""), (501, None)]
    own = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "id": F.lit(1), "kept": F.lit(2), "h": F.lit(3)})
    left = quality_model.filtered(own, own.where("doc_id < 200").select("doc_id"))
    assert left.columns == own.columns and Counter((x.doc_id, x.text) for x in left.where("doc_id >= 200 or doc_id is null").collect()) == {(500, text): 1, (None, text): 1}


def test_token_files(spark, docs, rows):
    path = new_path(spark, "token-files")
    one = docs.dropDuplicates(["doc_id"])
    token_files.write_token_files(one, path, tokenizer_path())
    tok = Tokenizer.from_file(tokenizer_path())
    got = {x.doc_id: x for x in token_files.token_file_digest(spark, path).collect()}
    back = {x.doc_id: x.ids for x in token_files.read_token_files(spark, path).collect()}
    start = 0
    for doc_id, text in sorted(dict(rows).items()):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        assert back[doc_id] == ids
        x = got[doc_id]
        assert (x.start, x.n_tokens, x.ids_crc32) == (start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))
        start += len(ids)
    empty = new_path(spark, "token-files")
    token_files.write_token_files(_empty(docs), empty, tokenizer_path())
    assert token_files.token_file_digest(spark, empty).count() == 0


def _components(sets):
    ids, up = list(sets), {}
    find = lambda x: x if up.get(x, x) == x else find(up[x])
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {x: find(x) for x in ids}


@pytest.mark.parametrize(("width", "chunk"), [(2, 384), (5, 384), (2, 8)])
def test_near_duplicates(spark, docs, rows, monkeypatch, width, chunk):
    monkeypatch.setattr(near_dups, "CHUNK", chunk)
    monkeypatch.setattr(common, "HOT_ROWS", chunk // 8)
    base = " ".join(f"k{k}" for k in range(120))
    near = [(20_000 + k, base.replace(f" k{k} ", f" z{k} ")) for k in range(1, 60)] + [(30_000 + k, " ".join(f"k{j}" for j in range(4 * k, 4 * k + 120))) for k in range(1, 30)]
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame(near, "doc_id long, text string"))
    sets = {}
    for doc_id, text in [*rows, *near]:
        w = (text or "").encode().lower().split()
        n = min(width, len(w))
        sets[doc_id] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    want = _components(sets)
    got = near_dups.near_duplicates(more, width=width).collect()
    assert len(got) == len(rows) + len(near)
    for x in got:
        assert (x.n_shingles, x.component_id, x.kept) == (len(sets[x.doc_id]), want[x.doc_id], want[x.doc_id] == x.doc_id)
    assert near_dups.near_duplicates(_empty(docs)).count() == 0
    left = near_dups.deduplicated(docs, width=width).collect()
    assert sorted(x.doc_id for x in left) == sorted(set(_components({k: v for k, v in sets.items() if k < 20_000}).values()))


@pytest.mark.parametrize("n", [5, 25, 500])
def test_groups_of_every_size(spark, n):
    """Groups of pairs near 0.8, linked or not, against brute force; size changes nothing."""
    import random

    draw = random.Random(n)
    base = [f"k{k}" for k in range(100)]
    texts = []
    for _ in range(n):
        own = list(base)
        for k in draw.sample(range(100), draw.randint(3, 9)):
            own[k] = f"z{draw.randint(0, 10**9)}"
        texts.append(" ".join(own[: draw.randint(80, 100)]))
    got = near_dups.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), width=1).collect()
    want = _components({k: set(t.split()) for k, t in enumerate(texts)})
    assert {x.doc_id: x.component_id for x in got} == want


def test_deduplicated_goes_by_row(spark):
    word = lambda k: " ".join(f"{k}w{j}" for j in range(20))
    rows = [(1, word("a"), 0), (2, word("a"), 1), (2, word("b"), 2), (None, word("a"), 3), (None, word("c"), 4), (None, word("c"), 5), (7, word("d"), 6), (7, word("d"), 7), (8, "", 8), (8, "", 9), (9, None, 10), (7, word("b"), 11), (3, word("e"), 12), (3, word("f"), 13), (4, word("e"), 14), (5, word("f"), 15)]
    own = spark.createDataFrame(rows, "doc_id long, text string, id int").withColumns({"h": F.lit(1), "group": F.lit(2), "stays": F.lit(3)})
    left = near_dups.deduplicated(own)
    assert left.columns == own.columns and sorted(x.id for x in left.collect()) == [0, 2, 4, 6, 8, 9, 10, 12, 13]


def test_components(spark):
    links = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (200, 201), (201, 200)]
    got = {x.id: x.component for x in near_dups.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, **{k: 100 for k in range(100, 130)}, 200: 200, 201: 200}


def test_toxicity(spark, docs, rows):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    big = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    got = toxicity.judged(big, labels).join(labels, "doc_id").where("held_out").groupBy("toxic", "predicted").count().collect()
    n = defaultdict(int, {(x.toxic, x.predicted): x["count"] for x in got})
    assert n[1, 1] >= 0.75 * (n[1, 1] + n[1, 0]) and n[0, 1] <= 0.01 * (n[0, 0] + n[0, 1])
    small = toxicity.judged(docs, labels.where("doc_id < 200")).collect()
    assert len(small) == len(rows) and all(0 <= x.score <= 1 and x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) for x in small)
    assert {x.predicted for x in toxicity.judged(docs, labels.where("false")).collect()} == {0}


def test_scores_are_sums_over_pairs(spark):
    """Scores against the sum over all pairs of terms, one by one."""
    import numpy as np

    draw = np.random.default_rng(3)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]
    rows = [(k, " ".join(draw.choice(words, draw.integers(0, 12)))) for k in range(300)] + [(300, None), (301, ""), (301, "waa wba"), (None, "waa")]
    own = spark.createDataFrame(rows, "doc_id long, text string")
    sampled = spark.createDataFrame([(k, int("waa" in t)) for k, t in rows[:300]], "id long, label int")
    buckets, machine = toxicity.train(own, sampled)
    place = {int(b): k for k, b in enumerate(buckets)}
    got = toxicity.scored(own, buckets, machine).collect()
    assert len(got) == len(rows)
    scores = sorted((x.score for x in got))
    want = []
    for _, text in rows:
        at = [place[t] for t in toxicity.terms(text) if t in place]
        z = machine.bias + sum(machine.w[i] for i in at) + sum(float(machine.v[i] @ machine.v[j]) for i in at for j in at if i < j)
        want.append(1 / (1 + math.exp(-z)))
    assert all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12) for a, b in zip(scores, sorted(want), strict=True))


def test_factors_learn_pairs_of_neutral_terms(spark):
    """Toxic only where both of two terms stand that are as common in clean texts: found end to end, through judged()."""
    import random

    draw = random.Random(1)
    words = [f"filler{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200)]
    rows = []
    for k in range(3000):
        a = draw.random() < 0.5
        b = draw.random() < 0.5
        toxic = a and b or not a and not b
        own = draw.sample(words, 15) + (["insulting"] if a else ["praising"]) + (["group"] if b else ["nobody"])
        draw.shuffle(own)
        rows.append((k, " ".join(own), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    found = toxicity.judged(docs, docs.select("doc_id", "toxic"), threshold=0.5).join(docs, "doc_id").where("held_out")
    right, n = found.agg(F.count_if(F.col("predicted") == F.col("toxic")), F.count("*")).first()
    assert right >= 0.95 * n


def _base(text):
    out = {k: [] for k in pii.KINDS}
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            if kind == "card" and not (13 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(d[::-1])) % 10 == 0):
                continue
            out[kind].append((m.start(), m.end()))
    return out


def test_pii(spark, docs, rows):
    told = [(40_000 + k, f"please call zorblat at z.orb@mail.org number{k} now") for k in range(4)] + [(40_010, "nobody but Zorblat was there")]
    more = docs.select("doc_id", "text", "term", "email").unionByName(spark.createDataFrame(told, "doc_id long, text string").withColumns({"term": F.lit(1), "email": F.lit(1)}))
    got = {x.doc_id: x for x in pii.digest(more).collect()}
    for doc_id, text in [*rows, *told]:
        base = _base(text)
        listed = ",".join(f"{k}:{s}:{e}" for k in pii.KINDS for s, e in base[k])
        x = got[doc_id]
        assert (x.n_email, x.n_ip, x.n_card, x.n_phone) == tuple(len(base[k]) for k in pii.KINDS), doc_id
        assert x.base_sha256 == hashlib.sha256(listed.encode()).hexdigest() and x.spans.startswith(listed)
    assert "term:12:19" in got[40_000].spans and got[40_010].spans == "term:11:18"
    clean = {x.doc_id: x.text for x in pii.redacted(more).collect()}
    assert clean[40_010] == "nobody but <TERM> was there" and "<EMAIL>" in clean[40_000] and "orblat" not in clean[40_000]
    assert clean[10_000] is None and clean[10_003] == "one" and clean[10_018] == "\U0001f600 mail <EMAIL> \U0001f600 <PHONE>"
    assert pii.digest(more).count() == len(rows) + len(told) and pii.digest(_empty(docs)).count() == 0


def _term_spans(spark, own):
    """Lower-case term spans by document, with 2,000 documents of common words behind own texts."""
    texts = [*own, *["reach them by letter before noon please now"] * 2000]
    got = pii.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).where(F.col("doc_id") < len(own)).collect()
    cut = lambda k, spans: {texts[k][int(a) : int(b)].lower() for kind, a, b in (x.split(":") for x in spans.split(",") if x) if kind == "term"}
    return {x.doc_id: cut(x.doc_id, x.spans) for x in got}


def test_pii_terms_of_rare_values(spark):
    once = ["please reach quuxley by q.x@mail.org now"]
    twice = ["please reach Vandermork by v.m@mail.org now", "reach vandermork by letter before v.m@mail.org please"]
    got = _term_spans(spark, [*once, *twice])
    assert got == {0: {"quuxley"}, 1: {"vandermork"}, 2: {"vandermork"}}


def test_pii_terms_far_from_values(spark):
    common = "reach them by letter before noon please now " * 5
    long = "honorificabilitudinitatibus" * 8
    far = [f"zorblat {common if k > 2 else ''} reach us by z.b@mail.org {common} {long} {common} quuxley" for k in range(10)]
    got = _term_spans(spark, far)
    assert all({"zorblat", "quuxley", long} <= x and not {"reach", "letter"} & x for x in got.values())


def test_bpe(docs, rows):
    tok = Tokenizer.from_file(tokenizer_path())
    got = {x.doc_id: x for x in trie_bpe.round_trip_digest(docs, tokenizer_path()).collect()}
    for doc_id, text in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids
        x = got[doc_id]
        assert (x.n_tokens, x.ids_sha256, x.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    tokens = trie_bpe.encoded(docs, tokenizer_path())
    assert {(x.id, x.text) for x in trie_bpe.decoded(tokens, tokenizer_path()).collect()} == {(d, t or "") for d, t in rows}
    assert trie_bpe.round_trip_digest(_empty(docs), tokenizer_path()).count() == 0


def test_cut_restores():
    for text in ODD:
        assert "".join(cut(text or "")) == (text or "")


def test_decontamination(spark, docs, rows, monkeypatch):
    items = [(x.item_id, x.text) for x in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    own = [(5000, None), (5001, ""), (5002, "same LINE same"), (5003, "a b c a b c")]
    bench = spark.createDataFrame([*items, *own, *items[:2]], "item_id long, text string")
    windows = defaultdict(set)
    for item, text in [*items, *own]:
        w = decontaminate.words(text)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k : k + 13])].add(str(item))
    for a_pass, at_once in ((50_000, 4), (9, 1000), (-(-bench.count() // 10), 3)):  # one part; many at once; ten, three at once
        monkeypatch.setattr(decontaminate, "ITEMS_A_PASS", a_pass)
        monkeypatch.setattr(decontaminate, "PARTS_AT_ONCE", at_once)
        found = decontaminate.judged(docs, bench).collect()
        assert len(found) == len(rows)
        got = {x.doc_id: x for x in found}
        for doc_id, text in rows:
            w = decontaminate.words(text)
            hit, named = set(), set()
            for k in range(len(w)):
                for n in {len(x) for x in windows}:
                    if items_of := windows.get(tuple(w[k : k + n])) if k + n <= len(w) else None:
                        hit |= set(range(k, k + n))
                        named |= items_of
            x = got[doc_id]
            assert (x.n_words, x.n_hit, x.n_items, x.contaminated) == (len(w), len(hit), len(named), bool(hit) and 20 * len(hit) >= len(w)), doc_id
            assert x.items_sha256 == hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()
    assert decontaminate.judged(docs, bench.where("false")).where("n_hit > 0 or contaminated").count() == 0
    assert decontaminate.judged(_empty(docs), bench).count() == 0


def test_decontamination_goes_by_row(spark, monkeypatch):
    """Null and repeated ids: the same rows with one part and with several."""
    line = " ".join(f"w{k}" for k in range(20))
    rows = [(1, line), (1, "clean"), (None, line), (None, "clean"), (None, "clean"), (2, line), (2, line), (3, None)]
    own = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"h": F.lit(1), "spans": F.lit(2)})
    bench = spark.createDataFrame([("a", line), ("b", "other words"), ("c", line + " more")], "item_id string, text string")
    for a_pass, at_once in ((50_000, 4), (1, 4), (1, 1)):
        monkeypatch.setattr(decontaminate, "ITEMS_A_PASS", a_pass)
        monkeypatch.setattr(decontaminate, "PARTS_AT_ONCE", at_once)
        assert sorted(tuple(x) for x in decontaminate.judged(own, bench).select(F.coalesce("doc_id", F.lit(0)), "n_hit", "n_items").collect()) == [(0, 0, 0), (0, 0, 0), (0, 20, 2), (1, 0, 0), (1, 20, 2), (2, 20, 2), (2, 20, 2), (3, 0, 0)]
        left = decontaminate.cleaned(own, bench)
        assert left.columns == own.columns and sorted(str((x.doc_id, x.text)) for x in left.collect()) == sorted(["(1, 'clean')", "(None, 'clean')", "(None, 'clean')", "(3, None)"])


def _redact(text, spans):
    out, at = "", 0
    for b, e, tag in sorted(spans):
        out, at = out + text[at:b] + tag, e
    return out + text[at:]


def test_redaction_keeps_other_columns(spark):
    rows = [(1, "write to x@y.com now", "seen"), (1, "nothing here", "seen"), (None, "write to x@y.com soon", "seen")]
    own = spark.createDataFrame(rows, "doc_id long, text string, email string").withColumns({"_id": F.lit(1), "term": F.lit("t"), "spans": F.lit(2), "ip": F.lit(3)})
    got = pii.redacted(own)
    assert got.columns == own.columns
    assert sorted((str(x.doc_id), x.text, x.email, x.term, x["_id"]) for x in got.collect()) == [("1", "nothing here", "seen", "t", 1), ("1", "write to <EMAIL> now", "seen", "t", 1), ("None", "write to <EMAIL> soon", "seen", "t", 1)]


def test_pii_terms_against_counts(spark, docs, rows):
    """Every term span of the small table against counts made with plain dictionaries."""
    n = len(rows)
    values, held, together = Counter(), Counter(), Counter()
    terms_of = [set(re.findall(r"[^\W\d_]{3,}", (t or "").lower())) for _, t in rows]
    for (_, text), terms in zip(rows, terms_of, strict=True):
        own = {text[s:e] for spans in _base(text).values() for s, e in spans}
        values.update(own)
        held.update(terms)
        together.update((v, t) for v in own for t in terms)
    telling = set()
    for (v, t), both in together.items():
        rate = values[v] / n
        share = (both + pii.PRIOR * rate) / (held[t] + pii.PRIOR)
        if rate < 1 and share >= pii.GIVEN and math.log(share / rate) / -math.log(rate) >= pii.DISCLOSURE:
            telling.add(t)
    got = Counter((x.doc_id, tuple(s for s in x.spans.split(",") if s.startswith("term"))) for x in pii.digest(docs).collect())
    want = Counter()
    for doc_id, text in rows:
        base = [b for spans in _base(text).values() for b in spans]
        own = [(m.start(), m.end()) for m in re.finditer(r"[^\W\d_]{3,}", text or "") if m[0].lower() in telling and not any(s < m.end() and m.start() < e for s, e in base)]
        want[doc_id, tuple(f"term:{s}:{e}" for s, e in own)] += 1
    assert got == want


def test_pii_in_a_long_list_of_contacts(spark):
    """20,000 addresses and 50,000 words in one document: no table of both, and no walk that grows with their product; a second list shares half of them."""
    name = lambda k: "".join("abcdefghij"[int(d)] for d in f"{k:06}")
    words = [f"w{name(k)}" for k in range(50_000)]
    mail = [f"x{name(k)}@mail.org" for k in range(20_000)]
    text = " ".join(x for k in range(50_000) for x in ([mail[k]] if k < 20_000 else []) + [words[k]])
    own = [(0, text), (1, " ".join(mail[:10_000])), *[(k, "reach them by letter before noon please now") for k in range(2, 2000)]]
    began = time.perf_counter()
    got = {x.doc_id: x for x in pii.digest(spark.createDataFrame(own, "doc_id long, text string")).collect()}
    assert time.perf_counter() - began < 120
    assert got[0].n_email == 20_000 and got[1].n_email == 10_000
    spans = [s.split(":") for s in got[0].spans.split(",")]
    assert [text[int(a) : int(b)] for k, a, b in spans if k == "term"] == words and [text[int(a) : int(b)] for k, a, b in spans if k == "email"] == mail
    assert "term" not in got[1].spans and got[5].spans == ""


def test_pii_names_of_columns(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    own = spark.createDataFrame([(1, "call quuxley at q.x@mail.org", 1, 2, 3)] + [(k, "nothing here", 1, 2, 3) for k in range(2, 2000)], "doc_id long, text string, _way int, _hot int, h int")
    got = pii.redacted(own)
    assert got.columns == own.columns and got.where("doc_id = 1").first().text == "  at <EMAIL>"


def test_filters_keep_names_of_columns(spark):
    """Columns of any name pass the filters, small sides or not."""
    texts = ["the quick brown fox jumps over the lazy dog near the river bank today", "the quick brown fox jumps over the lazy dog near the river bank today", None, "something else that nobody has ever said before in this town at all"]
    own = spark.createDataFrame([(k, t, "en", 1, 2, 3) for k, t in enumerate(texts)], "doc_id long, text string, lang string, _gone_id int, _gone_h int, h int")
    bench = spark.createDataFrame([("i", texts[3])], "item_id string, text string")
    got = decontaminate.cleaned(near_dups.deduplicated(own), bench)
    assert got.columns == own.columns and sorted(x.doc_id for x in got.collect()) == [0, 2]
    kept = quality_model.filtered(own, own.select("doc_id").where("doc_id < 2"))
    assert kept.columns == own.columns and 2 not in {x.doc_id for x in kept.collect()}


def test_pii_struck_share_does_not_grow(spark):
    """Ordinary words of whom one of several documents holds an address stay, however many documents there are."""
    for n in (300, 6000):
        own = [(0, "zorblat meets mail@some.org"), (1, "zorblat meets nobody"), *[(k, "reach them by letter before noon please now") for k in range(2, n)]]
        found = pii.disclosing_terms(spark.createDataFrame(own, "doc_id long, text string"))
        assert {x.term for x in found.collect()} <= {"some", "mail", "org"}


def test_warc_repeated_ids_and_cut_records(spark, tmp_path):
    pages = spark.createDataFrame([(5, "u", "AAAA"), (5, "u", "unique payload"), (5, "u", "CC"), (1, "u", "AAAA"), (2, "u", "CC")], "page_id long, url string, html string")
    path = new_path(spark, "warc")
    warc.write_archives(pages, path)
    got = sorted((x.page_id, x.payload_bytes, x.record_type, x.refers_to) for x in warc.digest(warc.read_archives(spark, path)).collect())
    assert got == [(1, 4, "response", None), (2, 2, "response", None), (5, 2, "revisit", 2), (5, 4, "revisit", 1), (5, 14, "response", None)]
    record = lambda n, body: f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{n}>\r\nContent-Length: {n}\r\n\r\n{body}\r\n\r\n"
    (tmp_path / "a.warc").write_bytes((record(3, "abc") + record(500, "short")).encode())
    assert [(x.record_id, x.payload_bytes) for x in warc.read_archives(spark, str(tmp_path)).collect()] == [("<urn:page:3>", 3)]


def test_one_bad_page_condemns_no_other_host(spark):
    urls = ["http://a.com/", "http://b.net/", "http://c.de/", "http://d.fr/", "http://e.co.uk/", "http://f.org.uk:80/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_filter.judged(pages, spark.createDataFrame([(0, 1)], "page_id long, bad int"), rules=[]).collect()
    assert {x.verdict for x in got} == {"allow"}
    many = spark.createDataFrame([(k, f"http://{h}/{k}") for k, h in enumerate(["me@bad.co.uk:80", "bad.co.uk", "good.co.uk", "fine.com"] * 50)], "page_id long, url string")
    judged = url_filter.judged(many, many.select("page_id", (F.col("page_id") % 4 < 2).cast("int").alias("bad")), rules=[]).collect()
    assert {(x.host, x.verdict) for x in judged} == {("me@bad.co.uk:80", "block"), ("bad.co.uk", "block"), ("good.co.uk", "allow"), ("fine.com", "allow")}


def test_pipeline(spark):
    """Stage by stage on the small table with null, empty and repeated rows and ids: what each does against its operator's brute-force version."""
    import corpus_pipeline

    own = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    line = " ".join(f"plain{k} word{k}" for k in range(40))
    odd = [(9000, None), (9001, ""), (None, line), (9002, line), (9002, line), (9003, bench), (9003, "short text of its own for this id"), (None, None), (9004, "write to a.b@mail.org " + " ".join(f"only{k}" for k in range(30)))]
    docs = own.unionByName(spark.createDataFrame([(i, t, "en", "x", None) for i, t in odd], own.schema))
    left = docs.persist()
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, left = left, stage(spark, left, SF).persist()
        assert left.columns == corpus_pipeline.COLUMNS and 0 < left.count() <= before.count(), name
        seen[name] = [(x.doc_id, x.text) for x in left.collect()]
        if name != "privacy":
            assert not Counter(seen[name]) - Counter((x.doc_id, x.text) for x in before.select("doc_id", "text").collect())
    assert not {t for _, t in seen["quality"]} & {None, ""}
    sets = {k: {tuple(t.encode().lower().split()[j : j + 5]) for j in range(max(1, len(t.split()) - 4))} for k, (_, t) in enumerate(seen["quality"])}
    up = _components(sets)
    kept = []
    for root in set(up.values()):
        kept.append(min((seen["quality"][k][0] is None, seen["quality"][k][0] or 0) for k in up if up[k] == root))
    assert sorted((i is None, i or 0) for i, _ in seen["near_duplicates"]) == sorted(kept)
    windows = {tuple(w[k : k + 13]) for x in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if (w := decontaminate.words(x.text)) for k in range(max(1, len(w) - 12))}
    sizes = {len(w) for w in windows}

    def clean(text):
        w = decontaminate.words(text)
        hit = {j for n in sizes for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows for j in range(k, k + n)}
        return not hit or 20 * len(hit) < len(w)

    assert Counter(seen["decontamination"]) == Counter(x for x in seen["near_duplicates"] if clean(x[1]))
    assert (9003, bench) not in seen["decontamination"]
    addresses = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
    assert len(seen["privacy"]) == len(seen["decontamination"]) and not any(re.search(addresses, t) for _, t in seen["privacy"])
    found = corpus_pipeline.STAGES[-1][1](spark, left, SF).collect()
    tok = Tokenizer.from_file(tokenizer_path())
    assert Counter((x.doc_id, x.n_tokens) for x in found) == Counter((i, len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in seen["privacy"])
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_pipeline_on_an_empty_table(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
