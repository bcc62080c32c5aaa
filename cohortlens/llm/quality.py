"""Quality rules with thresholds that adapt to each language and source.

Every document gets its measures in one pass of built-in functions. Each group of documents (language
and source) keeps one mergeable quantile sketch per measure; fences come from the sketches' quartiles
and are joined back to the documents. Besides, two fixed base rules fail a document outright.

Defined results: a NULL or empty text has no words and fails the base rules; NULL languages and sources
form groups of their own; repeated rows count as often as they occur; measures of texts of any length
cover the whole text; an empty table gives an empty result; input columns stay in ``row``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.joins import attach
from cohortlens.session import stage

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LEAST_WORDS = 50
#: Percent of words in repeated three-word windows beyond which the base fails.
MOST_REPEATED = 50
#: Fences lie so many quartile distances beyond the upper (or lower) quartile ...
REACH = 6.0
#: ... and this much further, so that groups without any spread tolerate small values.
RULES = {"symbol_share": 0.03, "dup_line_share": 0.35, "repeat_share": 0.3, "capital_share": 0.15, "word_length": 1.0}
#: These are fenced below, too.
TWO_SIDED = ("word_length",)
#: Items that a sketch keeps on its lowest level; up to so many rows its quantiles are exact.
SKETCH_K = 2048


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def removed(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more, compared by 64-bit hashes."""
    def windows(h: Column) -> Column:
        n = F.size(h)
        every = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
        return F.array_sort(F.transform(every, lambda i: F.struct(
            F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)).alias("k"), i.alias("p"))))

    def twice(s: Column) -> Column:
        same = F.transform(s, lambda x, i: F.when(
            (x["k"] == F.get(s, i + 1)["k"]) | (x["k"] == F.get(s, i - 1)["k"]), x["p"]))
        return F.array_sort(F.array_compact(same))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, i: F.least(F.lit(3), x - F.coalesce(F.get(p, i - 1), F.lit(-3))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return let(hashes, lambda h: let(windows(h), lambda s: let(twice(s), covered)))


def measures(text: Column) -> list[Column]:
    value = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(value, "\n"), lambda x: removed(x, SPACE) > 0)
    counted = let(words_of(value), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    return [
        counted.alias("counted"),
        removed(value, SPACE).cast("long").alias("word_chars"),
        (F.length(value) - removed(value, SYMBOLS)).cast("long").alias("n_symbols"),
        (F.length(value) - removed(value, CAPITALS)).cast("long").alias("n_capitals"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"),
                                      (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("lined"),
    ]


def measured(documents: DataFrame, text: str = "text", groups: tuple[str, ...] = ("lang", "source"),
             keep: list[str] | None = None) -> DataFrame:
    """``row`` (the ``keep`` columns), ``grouping`` and the measures of each document."""
    keep = list(documents.columns) if keep is None else keep
    rows = documents.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"),
                            F.struct(*(F.col(f"`{g}`").alias(f"g{i}") for i, g in enumerate(groups))).alias("grouping"),
                            *measures(F.col(f"`{text}`")))
    rows = rows.select("row", "grouping", "counted.*", "word_chars", "n_symbols", "n_capitals", "lined.*")

    def share(part: str, whole: str) -> Column:
        return F.col(part) / F.greatest(F.col(whole), F.lit(1))

    return rows.select(
        "*", share("n_symbols", "word_chars").alias("symbol_share"), share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"), share("n_capitals", "word_chars").alias("capital_share"),
        share("word_chars", "n_words").alias("word_length"),
        ((F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))).alias("base_failed"))


def sketches(rows: DataFrame, k: int = SKETCH_K) -> DataFrame:
    """One sketch per group and measure; partial sketches merge on the map side."""
    return rows.groupBy("grouping").agg(*(F.kll_sketch_agg_double(F.col(m), k).alias(m) for m in RULES))


def merged(tables: DataFrame) -> DataFrame:
    """Sketch tables of several runs (``unionByName``) merged into one."""
    return tables.groupBy("grouping").agg(*(F.kll_merge_agg_double(F.col(m)).alias(m) for m in RULES))


def fences(sketched: DataFrame, reach: float = REACH) -> DataFrame:
    """``grouping`` and, for each measure, the values that its documents must not lie beyond."""
    def quartile(m: str, q: float) -> Column:
        return F.kll_sketch_get_quantile_double(F.col(m), F.lit(q))

    def fence(m: str, slack: float) -> Column:
        low, high = quartile(m, 0.25), quartile(m, 0.75)
        bottom = low - reach * (high - low) - slack if m in TWO_SIDED else F.lit(None).cast("double")
        return F.struct(bottom.alias("low"), (high + reach * (high - low) + slack).alias("high")).alias(f"{m}_fence")

    return sketched.select("grouping", *(fence(m, slack) for m, slack in RULES.items()))


def judge(documents: DataFrame, text: str = "text", groups: tuple[str, ...] = ("lang", "source"),
          keep: list[str] | None = None, reach: float = REACH) -> DataFrame:
    """``row``, the measures, ``base_failed`` and ``kept``. The measures are staged once for both readers."""
    rows = stage(measured(documents, text, groups, keep))
    limits = fences(sketches(rows), reach)

    def inside(m: str) -> Column:
        below = F.coalesce(F.col(m) >= F.col(f"{m}_fence.low"), F.lit(True))
        return below & (F.col(m) <= F.col(f"{m}_fence.high"))

    ok = ~F.col("base_failed")
    for m in RULES:
        ok = ok & inside(m)
    # every group has its fences; as many as can be are broadcast after they were counted, the texts stay where they are
    return attach(rows, limits, ["grouping"], ["n_words", "word_chars", "n_symbols"]).select(*rows.columns, ok.alias("kept"))
