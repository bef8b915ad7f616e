"""Line-first quality rules in DataFrame expressions only.

Each line is judged first (closing punctuation, navigation, boilerplate); the
lines that fail go, and a document goes when too much of its text went with
them. Text-wide counts (symbols, repeated lines, repeated three-word windows)
come from the same row, so nothing is shuffled.

Defined results: a null text counts as empty; an empty or blank text has no
words and fails; repeated rows are judged alike, row by row; an empty table
gives an empty result; columns other than the two named ones are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\f\r"
SPACES = r"[\x20\x09-\x0D]+"
NON_SYMBOLS = r"[^#*$%&|<>]+"


@dataclass(frozen=True)
class LineRules:
    """What makes a line fail, and how much text a document may lose.

    ``closing``: some word of a line ends with one of these marks (quotes and
    brackets may follow), else the line is no prose. ``navigation``: breadcrumbs, menus and lists of links.
    ``boilerplate``: whole notices. ``min_kept_share``: share of the
    non-blank characters that must stay. No pattern may repeat a group that
    overlaps itself: matching must stay linear in the length of a line.
    """

    closing: str = r"[.!?…:;][\"'’”»)\]]*([\x20\x09-\x0D]|$)"
    navigation: str = r"^[^.!?|»>]*[|»>][^.!?|»>]*[|»>][^.!?]*$"
    boilerplate: str = (
        r"(?i)^[\x20\x09-\x0D]*(all rights reserved|copyright \(c\)|privacy policy|terms of (use|service)"
        r"|cookie (policy|settings)|click here|read more|sign (in|up)|subscribe|skip to content)[^.!?]*([.!?][\x20\x09-\x0D]*)?$"
    )
    min_kept_share: float = 0.5
    min_words: int = 50
    max_repeat_percent: int = 50


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The runs of other characters than ASCII white space."""
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))


def words_in_repeated_windows(words: Column) -> Column:
    """Words covered by three-word windows that occur twice or more.

    Sorting the windows of a row by hash brings equal ones together, so the
    cost is n log n in the length of the text, whatever repeats in it.
    """

    def repeated(w: Column) -> Column:
        windows = F.slice(
            F.transform(
                w,
                lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")),
            ),
            1,
            F.size(w) - 2,
        )
        return _let(F.sort_array(windows), covered)

    def covered(ordered: Column) -> Column:
        def twin(x: Column, j: Column) -> Column:
            before = F.coalesce(F.get(ordered, j - 1)["h"] == x["h"], F.lit(False))
            return before | F.coalesce(F.get(ordered, j + 1)["h"] == x["h"], F.lit(False))

        starts = F.transform(F.filter(ordered, twin), lambda x: x["i"])
        return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))

    return F.when(F.size(words) < 3, F.lit(0)).otherwise(_let(words, repeated))


def line_fails(line: Column, rules: LineRules) -> Column:
    return ~line.rlike(rules.closing) | line.rlike(rules.navigation) | line.rlike(rules.boilerplate)


def judge_documents(docs: DataFrame, rules: LineRules = LineRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: counts, base verdict, cleaned text, verdict."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    with_lines = base.select(
        "doc_id",
        "text",
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        words_of(F.col("text")).alias("words"),
    )
    chars = lambda c: F.char_length(F.regexp_replace(c, SPACES, "")).cast("long")
    counted = with_lines.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        chars(F.col("text")).alias("word_chars"),
        F.char_length(F.regexp_replace("text", NON_SYMBOLS, "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        words_in_repeated_windows(F.col("words")).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.array_join(F.filter("lines", lambda x: ~line_fails(x, rules)), "\n").alias("cleaned_text"),
    )
    failed = (F.col("n_words") < rules.min_words) | (
        100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")
    )
    return (
        counted.withColumn("kept_chars", chars(F.col("cleaned_text")))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("kept_chars") >= rules.min_kept_share * F.col("word_chars")))
    )
