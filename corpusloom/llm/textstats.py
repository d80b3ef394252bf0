"""Statistics of whole texts as DataFrame expressions: one narrow projection, no shuffle and no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._columns import named

#: Space and the characters from tab to carriage return.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 8

#: What word_statistics adds.
COLUMNS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_capitals", "n_marks")


def _count_of(chars: str, text: str) -> Column:
    return (F.length(text) - F.length(F.translate(F.col(text), chars, ""))).cast("long")


def _pairs(hashes: str, step: int) -> Column:
    """Hashes of each element with the one `step` further; null where there is none."""
    return F.zip_with(hashes, F.slice(F.col(hashes), step + 1, F.greatest(F.size(hashes) - step, F.lit(0))), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b)))


def word_statistics(docs: DataFrame, keep: list[Column], text: str = "text") -> DataFrame:
    """The columns `keep`, as _keep0, _keep1, ..., and COLUMNS of each text; a null text counts as empty.

    Words are runs of characters other than BLANKS. n_dup_lines: lines with a word that equal an earlier one.
    n_repeat_words: words in windows of 8 that are found twice or more in the text. Windows are compared by 64-bit hashes, made by
    doubling (1, 2, 4, 8 words)."""
    kept = [f"_keep{k}" for k in range(len(keep))]
    t = F.btrim(F.coalesce(named(text), F.lit("")), F.lit(BLANKS))
    df = docs.select(*[c.alias(k) for c, k in zip(keep, kept)], t.alias("_t"), F.coalesce(named(text), F.lit("")).alias("_all"))
    words = F.when(F.col("_t") == "", F.array().cast("array<string>")).otherwise(F.split("_t", r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split("_all", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    df = df.select(*kept, "_t", words.alias("_w"), lines.alias("_l"))
    df = df.select(
        *kept, F.transform("_w", lambda w: F.xxhash64(w)).alias("_h1"), F.size("_w").cast("long").alias("n_words"), F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        _count_of(SYMBOLS, "_t").alias("n_symbols"), F.size("_l").cast("long").alias("n_lines"), (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        _count_of(_CAPITALS, "_t").alias("n_capitals"), _count_of(".,;:!?\"'()-", "_t").alias("n_marks"),
    )
    base = [*kept, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_capitals", "n_marks"]
    df = df.select(*base, F.size(F.array_distinct("_h1")).cast("long").alias("n_distinct_words"), _pairs("_h1", 1).alias("_h2"))
    base.append("n_distinct_words")
    df = df.select(*base, _pairs("_h2", 2).alias("_h4")).select(*base, _pairs("_h4", 4).alias("_h8"))
    windows = F.slice(F.col("_h8"), 1, F.greatest(F.size("_h8") - (WINDOW - 1), F.lit(0)))
    df = df.select(*base, windows.alias("_h"))
    twice = F.size(F.array_distinct("_h")) < F.size("_h")
    placed = F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.select(*base, F.when(twice, placed).alias("_s"))
    same = F.transform("_s", lambda s, k: F.when((s["h"] == F.get(F.col("_s"), k - 1)["h"]) | (s["h"] == F.get(F.col("_s"), k + 1)["h"]), s["i"]))
    df = df.select(*base, F.array_sort(F.filter(same, lambda x: x.isNotNull())).alias("_p"))
    covered = F.transform("_p", lambda p, k: F.coalesce(F.least(F.get(F.col("_p"), k + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
    repeat = F.when(F.col("_p").isNull(), 0).otherwise(F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)).cast("long")
    return df.select(*base, repeat.alias("n_repeat_words"))


def base_failed() -> Column:
    """Too short, or too much of it repeats."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def vector() -> dict[str, Column]:
    """The statistics on scales on which ordinary texts are roughly normal."""
    words, chars, lines = (F.greatest(F.col(c), F.lit(1)).cast("double") for c in ("n_words", "word_chars", "n_lines"))
    return {
        "length": F.log(words),
        "word_length": F.log1p(F.col("word_chars") / words),
        "symbols": F.sqrt(F.col("n_symbols") / chars),
        "dup_lines": F.sqrt(F.col("n_dup_lines") / lines),
        "repeats": F.sqrt(F.col("n_repeat_words") / words),
        "capitals": F.sqrt(F.col("n_capitals") / chars),
    }


def steady() -> dict[str, Column]:
    """Statistics for classifiers. Those of short texts are drawn to what is usual, by a few imagined words, lines and characters."""
    words, chars, lines = (F.col(c).cast("double") for c in ("n_words", "word_chars", "n_lines"))
    return {
        "length": F.log1p(words),
        "word_length": F.log((chars + 100) / (words + 20)),
        "symbols": F.sqrt(F.col("n_symbols") / (chars + 40)),
        "dup_lines": F.sqrt(F.col("n_dup_lines") / (lines + 4)),
        "repeats": F.sqrt(F.col("n_repeat_words") / (words + 20)),
        "capitals": F.sqrt((F.col("n_capitals") + 2) / (chars + 100)),
        "distinct": F.log((F.col("n_distinct_words") + 16) / (words + 20)),
        "marks": F.sqrt((F.col("n_marks") + 3) / (chars + 100)),
        "line_length": F.log((words + 40) / (lines + 1)),
    }
