"""Quality rules: a table of thresholds compiled into column expressions.

Everything is a built-in expression over one row; the plan is a scan, a few
projections and a filter, with no shuffle and no user function.

Defined cases: a NULL text is an empty one; an empty text has no words and all
counts are 0; a ratio without a denominator passes its rule. Rows are judged one
by one, so repeated rows, ties and any further columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planar.llm.words import word_array

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 8

# Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in a is that it for was on with as by this at from an or are be "
    "de la que el en y los se del las un por con una para no es lo su "
    "le les et des est du dans qui au il ce ne sur pas par pour avec elle on ou "
    "der die und den von zu das mit sich auf für ist im dem nicht ein eine als auch"
).split()

# What a rule can speak about, from the struct of counts.
MEASURES = {
    "n_words": lambda q: q["n_words"],
    "repeat_pct": lambda q: F.try_divide(q["n_repeat_words"] * 100, q["n_words"]),
    "mean_word_chars": lambda q: F.try_divide(q["word_chars"], q["n_words"]),
    "symbol_ratio": lambda q: F.try_divide(q["n_symbols"], q["n_words"]),
    "stop_ratio": lambda q: F.try_divide(q["n_stop_words"], q["n_words"]),
    "echo_ratio": lambda q: F.try_divide(q["n_echo_words"], q["n_words"]),
    "dup_line_ratio": lambda q: F.try_divide(q["n_dup_lines"], q["n_lines"]),
}


@dataclass(frozen=True)
class Rule:
    """A text passes if ``low <= measure <= high``."""

    measure: str
    low: float | None = None
    high: float | None = None


BASE_RULES = (Rule("n_words", low=20), Rule("repeat_pct", high=30))
METHOD_RULES = (
    Rule("mean_word_chars", low=2, high=20),
    Rule("symbol_ratio", high=0.2),
    Rule("stop_ratio", low=0.02),
    Rule("echo_ratio", high=0.25),
    Rule("dup_line_ratio", high=0.5),
)


def compiled(rules: Sequence[Rule], counts: str) -> Column:
    """One boolean, true where every rule holds over the struct column ``counts``."""
    passed = F.lit(True)
    for rule in rules:
        value = MEASURES[rule.measure](F.col(counts))
        if rule.low is not None:
            passed &= F.coalesce(value >= F.lit(rule.low), F.lit(True))
        if rule.high is not None:
            passed &= F.coalesce(value <= F.lit(rule.high), F.lit(True))
    return passed


def _long(column: Column) -> Column:
    return column.cast("bigint")


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("bigint"), lambda a, n: a + n)


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc`` (the whole row as a struct) and ``counts``, a struct of bigints."""
    t = F.coalesce(F.col(f"doc.`{text}`"), F.lit(""))
    out = docs.select(F.struct("*").alias("doc")).select("doc", t.alias("t"))
    out = out.select(
        "doc", "t", word_array(F.col("t")).alias("words"),
        F.filter(F.split("t", "\n", -1), lambda line: _without(line, BLANKS) != F.lit("")).alias("lines"),
    )
    out = out.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    # Hashes of all windows of eight words, by position. ``hashes`` is named more
    # than once, which keeps the optimizer from copying it into the lambda.
    last = F.size("hashes") - F.lit(WINDOW)
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.slice("hashes", i + 1, WINDOW)))
    none = F.array().cast("array<bigint>")
    out = out.withColumn("windows", F.when(last >= 0, windows).otherwise(none))
    # Only texts in which a window returns are worth sorting for the positions.
    returns = F.size(F.array_distinct("windows")) < F.size("windows")
    by_hash = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    empty = F.array().cast("array<struct<h:bigint,i:int>>")
    out = out.withColumn("sorted", F.when(returns, by_hash).otherwise(empty))

    def like(s: Column, j: Column) -> Column:
        return F.coalesce(F.get("sorted", j)["h"] == s["h"], F.lit(False))

    twice = F.filter("sorted", lambda s, j: like(s, j - 1) | like(s, j + 1))
    out = out.withColumn("at", F.sort_array(F.transform(twice, lambda s: s["i"])))
    covered = F.transform(
        "at", lambda p, j: F.least(F.coalesce(F.get("at", j + 1) - p, F.lit(WINDOW)), F.lit(WINDOW))
    )
    length = _long(F.length("t"))
    counts = F.struct(
        _long(F.size("words")).alias("n_words"),
        _long(F.length(_without(F.col("t"), BLANKS))).alias("word_chars"),
        (length - _long(F.length(_without(F.col("t"), SYMBOLS)))).alias("n_symbols"),
        _long(F.size("lines")).alias("n_lines"),
        _long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        _total(covered).alias("n_repeat_words"),
        _long(F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS)))).alias("n_stop_words"),
        # Words that only say the word before them again.
        _long(F.size(F.filter("words", lambda w, j: F.coalesce(F.get("words", j - 1) == w, F.lit(False))))).alias(
            "n_echo_words"
        ),
    )
    return out.select("doc", counts.alias("counts"))


def score(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc``, ``counts``, ``base_failed`` and ``kept`` for every row.

    The optimizer would push a filter on the verdicts below the projections and so
    copy every array into each of its uses. It does not move one past a column that
    depends on the place of the row, so the verdicts ask for such a column, too.
    """
    placed = measured(docs, text).withColumn("place", F.monotonically_increasing_id())
    here = F.col("place") >= 0
    return placed.select(
        "doc", "counts",
        (here & ~compiled(BASE_RULES, "counts")).alias("base_failed"),
        (here & compiled(BASE_RULES + METHOD_RULES, "counts")).alias("kept"),
    )


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows that pass every rule, unchanged."""
    return score(docs, text).where("kept").select("doc.*")
