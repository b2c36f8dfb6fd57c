"""Quality rules: a threshold table compiled into Spark projections, without user functions.

The text statistics are chained as projections in one stage, with no shuffle. Repeated
three-word windows are found by sorting (window hash, position) inside the row, so the cost
stays n log n for a text of n words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftmark.llm.common import BLANKS, BLANK_CLASS, free_prefix

SYMBOLS = "#*$%&|<>"
# Frequent function words of English, German, French and Spanish.
STOP_WORDS = {
    "en": "a an and are as at be by for from in is it of on or that the this to was with",
    "de": "auf das dem den der des die ein eine für im in ist mit nicht sich und von zu",
    "fr": "avec dans de des du elle en est et il la le les ne pas pour que qui sur un une",
    "es": "como con de del el en es la las lo los no para por que se su un una y",
}


@dataclass(frozen=True)
class Rule:
    """``part / whole`` must lie within [low, high]; a zero ``whole`` fails no rule."""

    name: str
    part: str
    whole: str
    low: float = float("-inf")
    high: float = float("inf")


#: Conservative limits: well outside what running prose shows.
RULES = [
    Rule("word_length", "word_chars", "n_words", low=2.5, high=12.0),
    Rule("symbol_ratio", "n_symbols", "n_words", high=0.1),
    Rule("stop_words", "n_stop_words", "n_words", low=0.02),
    Rule("duplicate_lines", "n_dup_lines", "n_full_lines", high=0.6),
    Rule("capitals", "n_capitals", "word_chars", high=0.3),
    Rule("exclamations", "n_exclamations", "n_words", high=0.5),
    Rule("bullet_lines", "n_bullet_lines", "n_full_lines", high=0.9),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_full_lines", high=0.5),
]


def _repeated_words(words: Column, windows: Column) -> Column:
    """Words inside windows that occur twice or more; ``windows`` holds a hash for each start."""
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(s: Column) -> Column:
        same = lambda a, b: F.get(s, a)["h"] == F.get(s, b)["h"]
        twice = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: F.coalesce(same(j, j - 1), F.lit(False)) | F.coalesce(same(j, j + 1), F.lit(False)))
        return F.array_sort(F.transform(twice, lambda j: F.get(s, j)["i"]))

    def covered(at: Column) -> Column:
        # a window adds the words up to the next window's start, three at most
        return F.aggregate(F.transform(at, lambda i, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - i, F.lit(3)))), F.lit(0).cast("long"), lambda acc, x: acc + x)

    found = F.transform(F.transform(F.array(pairs), starts), covered)[0]
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(found)


def _matches(text: Column, pattern: str) -> Column:
    """How many characters of ``text`` the class ``pattern`` matches."""
    return F.char_length(F.regexp_replace(text, f"[^{pattern}]+", "")).cast("long")


def text_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the counts that the rules divide, all long. A null or empty text has zero of each."""
    # bulky helper columns stay attributes: each is used more than once, so no projection inlines it
    t, w, l, g = (free_prefix(docs) + x for x in "twlg")  # noqa: E741
    out = docs.withColumn(t, F.coalesce(F.col(text_col), F.lit("")))
    out = out.withColumns({
        w: F.filter(F.split(t, BLANK_CLASS + "+"), lambda w: w != ""),
        l: F.filter(F.split(t, "\n", -1), lambda x: F.char_length(F.btrim(x, F.lit(BLANKS))) > 0),
    })
    windows = F.transform(F.array(w), lambda ws: F.transform(
        F.when(F.size(ws) >= 4, F.sequence(F.lit(0), F.size(ws) - 3)).otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2))))[0]
    out = out.withColumn(g, windows)
    stop = sorted({w for line in STOP_WORDS.values() for w in line.split()})
    starts = lambda marks: (lambda x: F.btrim(x, F.lit(BLANKS)).rlike(marks))
    return out.withColumns({
        "n_words": F.size(w).cast("long"),
        "word_chars": F.char_length(F.array_join(w, "")).cast("long"),
        "n_symbols": _matches(F.col(t), SYMBOLS),
        "n_dup_lines": (F.size(l) - F.size(F.array_distinct(l))).cast("long"),
        "n_repeat_words": _repeated_words(F.col(w), F.col(g)),
        "n_full_lines": F.size(l).cast("long"),
        "n_capitals": _matches(F.col(t), "\\p{Lu}"),
        "n_exclamations": _matches(F.col(t), "!"),
        "n_stop_words": F.size(F.filter(w, lambda w: F.lower(F.btrim(w, F.lit(".,;:!?\"()"))).isin(stop))).cast("long"),
        "n_bullet_lines": F.size(F.filter(l, starts("^[-*\\u2022]"))).cast("long"),
        "n_ellipsis_lines": F.size(F.filter(l, starts("(\\.\\.\\.|\\u2026)$"))).cast("long"),
    }).drop(t, w, l, g)


def quality_rules(docs: DataFrame, text_col: str = "text", rules: list[Rule] | None = None, min_words: int = 50,
                  max_repeat_percent: int = 50) -> DataFrame:
    """Add the statistics, ``base_failed``, ``failed_rules`` (array of names) and ``kept``.

    ``base_failed``: fewer than ``min_words`` words, or over ``max_repeat_percent`` % of them in
    repeated windows. ``kept``: not ``base_failed`` and no rule failed. Null and empty texts have
    no words, so they fail the base. Rows are judged one by one: repeated rows give the same
    verdict, an empty table gives no rows, and added columns replace input columns of their names.
    """
    rules = RULES if rules is None else rules
    out = text_statistics(docs, text_col)
    verdicts = [
        F.when((F.col(r.whole) > 0) & ~(F.col(r.part) / F.col(r.whole)).between(r.low, r.high), F.lit(r.name)) for r in rules]
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    out = out.withColumns({"base_failed": base, "failed_rules": F.array_compact(F.array(*verdicts)) if verdicts else F.array().cast("array<string>")})
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
