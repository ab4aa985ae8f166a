"""PII: base patterns, and information-theoretic sanitisation, in SQL functions only.

The patterns find e-mail addresses, IP addresses, card and phone numbers. What they find is
protected. A term discloses a protected value if knowing the term tells nearly all there
is to know of it: with counts of documents, the pointwise mutual information of
term and value, log(N n(e,t) / (n(e) n(t))), comes up to DISCLOSURE of the value's information,
log(N / n(e)). All counts are over whole documents of the whole corpus. The share n(e,t) / n(t) is
shrunk by PRIOR documents that hold the term and, at the corpus' rate n(e) / N, the value: a term seen in
few documents must tell more, and no count is too small to be asked. Besides, the shrunk share itself must come up to GIVEN: a
value's information grows with the corpus, and by it alone ever more ordinary words would do. Wherever such a term stands in the
corpus it is a span too. Redaction removes terms that never stand without the value and generalises the others.

Values that stand in the same documents have the same counts with every term, so they are counted as one class: a list of
contacts that stand nowhere else is one class, however long. A class meets only terms that are rare enough for it. Positions, look-ups of terms
and of spans go by blocks, buckets and stretches, so that a very long text costs little more a character than a short one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctual.llm.common import is_small, join_dealt, left_join_hot, stored

KINDS = ("email", "ip", "card", "phone")
DISCLOSURE, PRIOR, GIVEN = 0.9, 1.0, 0.5
#: Matches of a block, terms of a bucket at most (up to BUCKETS of them), code points of a stretch of text.
BLOCK, BUCKET, BUCKETS, STRETCH = 256, 16, 512, 4096
TERM = r"\p{L}{3,}"
# Possessive, so that no run of characters is tried again from within and no recursion grows with a text. An address
# may begin within a run of its characters only where the match before it ended.
_PATTERN = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for the pattern to be worth trying.
_HINT = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


_SPANS = "array<struct<start:int,end:int,value:string>>"


def _found(text: Column, pattern: str) -> Column:
    """start, end, value of all matches, in order: from the matches and the stretches between them, block by block."""
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("gaps"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))

    def step(a: Column, x: Column) -> Column:
        begin = a["at"] + x["gap"]
        end = begin + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["m"].alias("value")))).alias("out"))

    def blocks(b: Column) -> Column:
        numbered = F.transform(b["m"], lambda m, k: F.struct(m.alias("m"), F.length(F.get(b["gaps"], k)).alias("gap")))
        return _let(numbered, lambda n: F.transform(F.sequence(F.lit(0), F.greatest(F.size(n) - 1, F.lit(0)), F.lit(BLOCK)), lambda k: F.aggregate(F.slice(n, k + 1, BLOCK), start, step)))

    def placed(done: Column) -> Column:
        begins = F.aggregate(done, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda a, x: F.struct((a["at"] + x["at"]).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
        moved = lambda at: lambda x: F.struct((at + x["start"]).alias("start"), (at + x["end"]).alias("end"), x["value"].alias("value"))
        return _let(begins, lambda b: F.flatten(F.transform(done, lambda x, k: F.transform(x["out"], moved(F.get(b, k))))))

    return _let(_let(both, blocks), placed)


def _luhn(digits: Column) -> Column:
    def value(k: Column) -> Column:
        d = F.substr(digits, F.length(digits) - k, F.lit(1)).cast("int")
        return F.when(k % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda a, k: a + value(k)) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, F.lit("[^0-9]"), F.lit(""))
    n = F.length(digits)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.regexp_replace(p, F.lit("^0+"), F.lit("")).rlike(r"^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when((n >= 13) & (n <= 19), _luhn(digits)).otherwise(False)
    return (n >= 9) & (n <= 15) if kind == "phone" else F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """array of (start, end, value) in code points, end exclusive; empty for a null text."""
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.when(text.rlike(_HINT[kind]), F.filter(_found(text, _PATTERN[kind]), lambda s: _holds(kind, s["value"]))).otherwise(none)


def _all_base(text: Column) -> Column:
    """A struct of the spans of each kind."""
    return F.struct(*[base_spans(text, k).alias(k) for k in KINDS])


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def disclosing_terms(docs: DataFrame, text_col: str = "text", disclosure: float = DISCLOSURE, prior: float = PRIOR, given: float = GIVEN) -> DataFrame:
    """term, nt (its documents), removed (it tells everything) of the terms beyond the thresholds.

    All counts are of rows of docs, over whole texts, and are combined before the shuffle; equal texts are counted together.
    """
    based = docs.select(F.col(text_col).alias("text"), _all_base(F.col(text_col)).alias("base"))
    total = docs.count()
    text, spans = F.coalesce(F.col("text"), F.lit("")), F.concat(*[F.col(f"base.{k}") for k in KINDS])
    own = based.where(F.size(spans) > 0).select(F.xxhash64(text).alias("h"), F.array_distinct(F.transform(spans, lambda s: F.xxhash64(s["value"]))).alias("values"), _terms(text).alias("terms"))
    mentions = stored(own.groupBy("h").agg(F.count("*").alias("m"), F.first("values").alias("values"), F.first("terms").alias("terms")), "mentions")
    # values by the set of their documents: two sums of hashes tell sets apart
    one = mentions.select("h", "m", F.explode("values").alias("value"))
    marks = [F.bit_xor(F.xxhash64("h", F.lit(k))).alias(f"x{k}") for k in (1, 2)]
    values = stored(one.groupBy("value").agg(F.sum("m").alias("ne"), *marks), "values")
    classes = stored(left_join_hot(one, values, "value", "h").where(F.col("ne") < total).select("h", "m", "ne", "x1", "x2").distinct(), "classes")
    rate = F.col("ne") / F.lit(float(max(total, 1)))
    # a term of more documents can't come up to the thresholds, though all of the class's documents hold it
    least = F.greatest(F.lit(given), F.pow(rate, F.lit(1.0 - disclosure)))
    rarest = (F.col("ne") + prior * rate) / least - prior + 1e-6
    most = classes.agg(F.max(rarest)).first()[0] or 0.0
    # all words are counted, combined before the shuffle: asking only for those of mentions would keep ever more of them as the corpus grows
    terms = stored(based.select(F.explode(_terms(text)).alias("term")).groupBy("term").agg(F.count("*").alias("nt")).where(F.col("nt") <= most), "terms")
    rare = join_dealt(mentions.select("h", F.explode("terms").alias("term")), terms, "term", terms.select("term", F.col("nt").alias("_w")), "h")
    together = rare.join(classes, "h").where(F.col("nt") <= rarest).groupBy("ne", "x1", "x2", "term", "nt").agg(F.sum("m").alias("net"))
    share = (F.col("net") + prior * rate) / (F.col("nt") + prior)
    best = together.where((share >= given) & (F.log(share / rate) / -F.log(rate) >= disclosure))
    return best.groupBy("term").agg(F.max("nt").alias("nt"), F.bool_or(F.col("net") == F.col("nt")).alias("removed"))


def with_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", disclosure: float = DISCLOSURE, prior: float = PRIOR, into: str = "spans") -> DataFrame:
    """docs with a column `into`, a struct of the spans of each kind and of `term`: (start, end, removed) of disclosing terms outside base spans.

    It goes by row and text: rows with null or repeated ids are rows of their own. Null texts have no spans. Other columns
    pass through, whatever their names; one named as `into` is replaced.
    """
    mark = uuid.uuid4().hex
    key, base, held = f"key_{mark}", f"base_{mark}", f"held_{mark}"
    flagged = stored(disclosing_terms(docs, text_col, disclosure, prior), "disclosing")
    text = F.coalesce(F.col(text_col), F.lit(""))
    # the terms that a text holds, by a hash of the text: texts that share a hash only share what is looked for in them
    words = docs.select(F.xxhash64(text).alias(key), F.explode(_terms(text)).alias("term"))
    told = flagged.select("term", "removed")
    held_words = words.join(F.broadcast(told), "term") if is_small(told) else join_dealt(words, told, "term", flagged.select("term", F.col("nt").alias("_w")), key)
    holding = stored(held_words.groupBy(key).agg(F.collect_set(F.struct("term", "removed")).alias(held)), "holding")
    based = docs.withColumns({base: _all_base(F.col(text_col)), key: F.xxhash64(text)})
    joined = left_join_hot(based, holding, key, id_col)
    every = F.concat(*[F.col(f"{base}.{k}") for k in KINDS])
    none = F.array().cast("array<struct<start:int,end:int,removed:boolean>>")
    terms = F.when(F.col(held).isNotNull(), _outside(_kept(text, F.col(held)), every)).otherwise(none)
    return joined.withColumn(into, F.struct(*[F.col(f"{base}.{k}").alias(k) for k in KINDS], terms.alias("term"))).drop(key, base, held)


def _kept(text: Column, held: Column) -> Column:
    """start, end, removed of the words of text that are among the held terms, which lie in buckets by hash."""
    n = F.least(F.lit(BUCKETS), F.greatest(F.lit(1), F.ceil(F.size(held) / BUCKET).cast("int")))
    bucket = lambda x, n: F.pmod(F.xxhash64(x), n.cast("long")).cast("int")
    dealt = _let(F.struct(held.alias("held"), n.alias("n")), lambda b: F.transform(F.sequence(F.lit(0), b["n"] - 1), lambda k: F.filter(b["held"], lambda h: bucket(h["term"], b["n"]) == k)))

    def looked_up(b: Column) -> Column:
        def told(x: Column) -> Column:
            word = F.lower(x["value"])
            return F.get(F.filter(F.get(b["dealt"], bucket(word, F.size(b["dealt"]))), lambda h: h["term"] == word), F.lit(0))["removed"]

        return F.filter(F.transform(b["words"], lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), told(x).alias("removed"))), lambda x: x["removed"].isNotNull())

    return _let(F.struct(_found(text, TERM).alias("words"), dealt.alias("dealt")), looked_up)


def _outside(words: Column, spans: Column) -> Column:
    """The words that overlap none of the spans. Spans are listed by the stretches that they touch, and a word meets those of its own."""

    def of(b: Column) -> Column:
        last = F.floor(F.greatest(F.coalesce(F.array_max(F.transform(b["words"], lambda w: w["end"])), F.lit(0)), F.lit(0)) / STRETCH).cast("int")
        touching = F.transform(F.sequence(F.lit(0), last), lambda k: F.filter(b["spans"], lambda s: (s["start"] < (k + 1) * STRETCH) & (s["end"] > k * STRETCH)))

        def free(c: Column) -> Column:
            meets = lambda w, k: F.exists(F.get(c["touching"], k), lambda s: (s["start"] < w["end"]) & (w["start"] < s["end"]))
            at = lambda x: F.floor(x / STRETCH).cast("int")
            # a word that reaches over a stretch meets all spans
            long = lambda w: F.exists(c["spans"], lambda s: (s["start"] < w["end"]) & (w["start"] < s["end"]))
            return F.filter(c["words"], lambda w: ~F.when(at(w["end"]) - at(w["start"]) > 1, long(w)).otherwise(meets(w, at(w["start"])) | meets(w, at(w["end"]))))

        return _let(F.struct(b["words"].alias("words"), b["spans"].alias("spans"), touching.alias("touching")), free)

    return _let(F.struct(words.alias("words"), spans.alias("spans")), of)


def _listed(spans: str, kinds: tuple[str, ...]) -> Column:
    of = lambda k: F.transform(F.col(f"{spans}.{k}"), lambda s: F.concat_ws(":", F.lit(k), s["start"], s["end"]))
    return F.array_join(F.concat(*[of(k) for k in kinds]), ",")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, the number of spans of each base kind, base_sha256 and spans, one row for each row of docs."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = with_spans(own, "id", "text", into="found")
    return found.select(F.col("id").alias(id_col), *[F.size(f"found.{k}").cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(_listed("found", KINDS), 256).alias("base_sha256"), _listed("found", (*KINDS, "term")).alias("spans"))


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, each span replaced by its kind in angle brackets, terms that tell everything by nothing. Null texts stay null; only text_col changes."""
    spans = f"spans_{uuid.uuid4().hex}"
    found = with_spans(docs, id_col, text_col, into=spans)
    tagged = lambda k: F.transform(F.col(f"{spans}.{k}"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), (F.when(s["removed"], "").otherwise("<TERM>") if k == "term" else F.lit(f"<{k.upper()}>")).alias("tag")))
    every = F.array_sort(F.concat(*[tagged(k) for k in (*KINDS, "term")]))
    text, start = F.col(text_col), F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        cut = F.concat(a["out"], F.substr(text, a["at"] + 1, F.greatest(F.lit(0), s["start"] - a["at"])), F.when(s["start"] >= a["at"], s["tag"]).otherwise(F.lit("")))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), cut.alias("out"))

    whole = F.aggregate(every, start, step, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1, F.length(text))))
    return found.withColumn(text_col, F.when(F.size(every) > 0, whole).otherwise(text)).select(*docs.columns)
