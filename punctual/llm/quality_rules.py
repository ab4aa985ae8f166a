"""Quality rules as a short-circuit cascade, in SQL functions only.

Each rule rejects documents by measures of their text, which are worked out where the rule is asked. On a bounded sample of raw texts
the operator times each rule, from the text on, and counts what it rejects, and then asks the rules in
order of rejections per cost: a document that an early rule rejects is not measured for later ones. Costs are taken to the
nearest power of two, so that the order does not hang on the noise of a clock. It changes the time taken and
the rule that is named, never the verdict.
"""

from __future__ import annotations

import math
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows on which costs and selectivities are estimated.
SAMPLE_ROWS = 1000
WORD = r"[^\x20\x09-\x0D]+"


Measure = Callable[[str], Column]


@dataclass(frozen=True)
class Rule:
    name: str
    #: What it rejects: a column, or a function of measures by name.
    rejects: Column | Callable[[Measure], Column]
    #: Words for the base filter, which holds whatever else a user asks for.
    base: bool = False

    def of(self, measure: Measure) -> Column:
        return self.rejects if isinstance(self.rejects, Column) else self.rejects(measure)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value worked out once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _count(text: Column, others: str) -> Column:
    """Code points of text that the class of `others` does not hold."""
    return F.length(F.regexp_replace(text, F.lit(others), F.lit(""))).cast("long")


def _repeated(words: Column) -> Column:
    """Words that stand in a window of three words found at least twice. Windows are compared by 64-bit hashes."""
    none = F.lit(0).cast("long")

    def covered(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda w, k: F.struct(w.alias("w"), k.alias("k"))))

        def places(s: Column) -> Column:
            again = lambda x, k: F.coalesce(F.get(s, k - 1)["w"] == x["w"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["w"] == x["w"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, again), lambda x: x["k"]))

        start = F.struct(F.lit(-3).alias("k"), none.alias("n"))
        total = F.aggregate(_let(ordered, places), start, lambda a, k: F.struct(k.alias("k"), (a["n"] + F.least(F.lit(3), k - a["k"])).alias("n")))["n"]
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), none).otherwise(total)

    windows = F.transform(F.slice(words, F.lit(1), F.size(words) - 2), lambda w, k: F.xxhash64(w, F.get(words, k + 1), F.get(words, k + 2)))
    return F.when(F.size(words) < 3, none).otherwise(_let(windows, covered))


def _content_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def from_text(text_col: str = "text") -> Measure:
    """Measures by name, each worked out from the text alone."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    again = lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")
    own = {
        "n_words": lambda: F.regexp_count(text, F.lit(WORD)).cast("long"),
        "word_chars": lambda: _count(text, r"[\x20\x09-\x0D]+"),
        "n_symbols": lambda: _count(text, r"[^#*$%&|<>]+"),
        "n_lines": lambda: F.size(_content_lines(text)).cast("long"),
        "n_dup_lines": lambda: _let(_content_lines(text), again),
        "n_repeat_words": lambda: _let(_words(text), _repeated),
        "capitals": lambda: _count(text, "[^A-Z]+"),
    }
    return lambda name: own[name]()


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words of the whole text. A null text has none of them: all are 0."""
    text, of = F.coalesce(F.col(text_col), F.lit("")), from_text(text_col)
    words = _let(_words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeated(w).alias("again")))
    of_lines = _let(_content_lines(text), lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("again")))
    w, x = (f"{k}_{uuid.uuid4().hex}" for k in ("words", "lines"))
    columns = {"n_words": F.col(f"{w}.n"), "word_chars": of("word_chars"), "n_symbols": of("n_symbols"), "n_lines": F.col(f"{x}.n"), "n_dup_lines": F.col(f"{x}.again"), "n_repeat_words": F.col(f"{w}.again")}
    return docs.withColumns({w: words, x: of_lines}).withColumns(columns).drop(w, x)


def standard_rules() -> list[Rule]:
    """The base filter, and rules for symbols, repeated lines, word lengths and capitals."""
    return [
        Rule("few_words", lambda m: m("n_words") < 50, base=True),
        Rule("repeated_windows", lambda m: m("n_repeat_words") * 100 > m("n_words") * 50, base=True),
        Rule("symbols", lambda m: m("n_symbols") * 10 > m("n_words")),
        Rule("repeated_lines", lambda m: m("n_dup_lines") * 100 > m("n_lines") * 30),
        Rule("word_length", lambda m: (m("word_chars") < m("n_words") * 2) | (m("word_chars") > m("n_words") * 15)),
        Rule("capitals", lambda m: m("capitals") * 100 > m("word_chars") * 30),
    ]


def ordered_rules(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, rounds: int = 3) -> list[Rule]:
    """Rules by rejections per cost on at most sample_rows rows of docs, most first; of equals the cheaper, then as given.

    The sample is drawn by a hash of ids at a rate that leaves about twice as many rows of the whole table, so that no task gathers more than these.
    A rule's cost is the shortest of its timed rounds, after one to warm up, less that of a job that only reads the texts. Rules stay as given on an empty sample.
    """
    one_in = max(1, docs.count() // (2 * sample_rows))
    sample = docs.where(F.pmod(F.xxhash64(id_col), F.lit(one_in)) == 0).limit(sample_rows).persist()
    try:
        if not sample.count():
            return rules

        def timed(condition: Column) -> tuple[float, int]:
            took, n = [], 0
            for _ in range(rounds + 1):
                began = time.perf_counter()
                n = sample.agg(F.count_if(condition)).first()[0]
                took.append(time.perf_counter() - began)
            return min(took[1:]), n

        idle = timed(F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) < 0)[0]
        worth = {}
        for rule in rules:
            took, rejected = timed(rule.of(from_text(text_col)))
            step = round(math.log2(max(took - idle, 1e-3)))
            worth[rule.name] = (-rejected / 2.0**step, step)
        return sorted(rules, key=lambda r: worth[r.name])
    finally:
        sample.unpersist()


def cascade(docs: DataFrame, rules: list[Rule], measure: Measure) -> DataFrame:
    """docs with rejected_by: the first of rules that rejects the row, null if none does. A measure that is null rejects nothing.

    Later rules, and their measures, are worked out only for rows that the earlier ones leave.
    """
    if not rules:
        return docs.withColumn("rejected_by", F.lit(None).cast("string"))
    first = F.when(rules[0].of(measure), rules[0].name)
    for rule in rules[1:]:
        first = first.when(rule.of(measure), rule.name)
    return docs.withColumn("rejected_by", first)


def filtered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs with rejected_by and kept alone: nothing is measured that no rule asks for."""
    rules = standard_rules() if rules is None else rules
    order = ordered_rules(docs, rules, id_col, text_col, sample_rows)
    return cascade(docs, order, from_text(text_col)).withColumn("kept", F.col("rejected_by").isNull())


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs with its measures, base_failed, rejected_by and kept, one row for each row of docs (repeated ones too).

    The measures of the base filter and of the report are worked out for every row; of the others only what the cascade
    comes to. Null and empty texts have no words and fail the base filter. Extra columns of docs pass through, except those
    named as a measure or result is: these are replaced. An empty table gives an empty result.
    """
    rules = standard_rules() if rules is None else rules
    order = ordered_rules(docs, rules, id_col, text_col, sample_rows)
    with_measures, raw = measured(docs, text_col), from_text(text_col)
    reported = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    measure = lambda name: F.col(name) if name in reported else raw(name)
    base = F.lit(False)
    for rule in rules:
        base = base | rule.of(measure) if rule.base else base
    return cascade(with_measures.withColumn("base_failed", base), order, measure).withColumn("kept", F.col("rejected_by").isNull())
