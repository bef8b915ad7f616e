"""Document fingerprints by winnowing, in DataFrame expressions only.

A text's tokens are its runs of letters, marks and digits, lower-cased; characters of scripts written
without spaces are tokens of their own. Every ``GRAM`` neighbouring tokens are hashed, and of every
``WINDOW`` neighbouring hashes the least is marked, of equal ones the rightmost. So any
``GRAM + WINDOW - 1`` tokens that two texts share leave a common mark, whatever
stands around them, and no common mark comes from fewer than ``GRAM``
tokens. Marks keep their position, the number of the gram's first token.

Hash and position of a gram are one long, the hash above the inverted position, so that the least
long is the rightmost least hash; window minima come from doubling steps, each a
pass over the array. Nothing is exploded or shuffled for a fingerprint.

The document after each is found by chunks of neighbouring order values
(:mod:`datumgate.functions.ordered`): one row per chunk crosses a border, texts are shuffled once.

Defined results: a null text counts as empty; an empty text has no mark, two such are alike (1) and
like no other text (0). A text without letters and digits is one token. A text of fewer than ``GRAM``
tokens is one gram, one of fewer than ``WINDOW`` grams one window. A null id comes after all others.
Rows with one id follow each other by the hash of their text; repeated rows are documents of their own,
next to each other. The only row of a table is its own next one. An empty table gives an
empty result. Columns of the table named like a new one are replaced, all others pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.local import local_frame
from ..functions.ordered import borders_of, chunk_of

GRAM = 5
WINDOW = 4
CHUNKS_A_PARTITION = 4
NO_ID = -(2**63)
_LAST = (1 << 31) - 1
_HASH_BITS = (1 << 32) - 1
# Scripts written without spaces between words.
_UNSPACED = "\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsThai}\\p{IsLao}\\p{IsKhmer}\\p{IsMyanmar}"
_BETWEEN = f"(?<=[{_UNSPACED}])|(?=[{_UNSPACED}])|[^\\p{{L}}\\p{{M}}\\p{{N}}]+"
_WORD = "[\\p{L}\\p{M}\\p{N}]+"
_NEW = ("n_chars", "marks", "edited_text", "edited_marks", "near_edited", "near_next")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def token_hashes(text: Column) -> Column:
    """Hashes of the tokens of a text that is not null."""

    def of(t: Column) -> Column:
        plain = F.regexp_extract_all(t, F.lit(_WORD), F.lit(0))
        cut = F.filter(F.split(t, _BETWEEN), lambda x: x != "")
        return F.transform(F.when(t.rlike(f"[{_UNSPACED}]"), cut).otherwise(plain), lambda x: F.xxhash64(x))

    def whole(t: Column, found: Column) -> Column:
        return F.when((F.size(found) > 0) | (t == ""), found).otherwise(F.array(F.xxhash64(t)))

    return _let(F.lower(text), lambda t: _let(of(t), lambda found: whole(t, found)))


def _packed_grams(tokens: Column, gram: int) -> Column:
    """One long for each gram: its hash, then its inverted position."""

    def pack(i: Column) -> Column:
        hashed = F.xxhash64(*[F.get(tokens, i + k) for k in range(gram)])
        return F.shiftleft(hashed.bitwiseAND(F.lit(_HASH_BITS)), 31) + (F.lit(_LAST) - i)

    places = F.sequence(F.lit(0), F.greatest(F.size(tokens) - gram, F.lit(0)))
    return F.when(F.size(tokens) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(places, pack))


def _window_minima(values: Column, window: int) -> Column:
    """The least of every ``window`` neighbours, of all if there are fewer; each once, in order."""

    def pairs(a: Column, shift: int, width: int) -> Column:
        """Minima of windows of ``width + shift`` from those of ``width``, shift <= width."""
        count = F.size(a) - shift
        return F.zip_with(F.slice(a, F.lit(1), count), F.slice(a, F.lit(1 + shift), count), lambda x, y: F.least(x, y))

    def widen(a: Column, width: int) -> Column:
        if width == window:
            return F.array_distinct(a)
        shift = min(width, window - width)
        return _let(pairs(a, shift, width), lambda b: widen(b, width + shift))

    short = F.when(F.size(values) == 0, values).otherwise(F.array(F.array_min(values)))
    return F.when(F.size(values) <= window, short).otherwise(widen(values, 1))


def packed_marks(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """The marks of a text as longs, by position."""
    grams = _let(token_hashes(F.coalesce(text, F.lit(""))), lambda t: _packed_grams(t, gram))
    return _let(grams, lambda g: _window_minima(g, window))


def _hash_of(mark: Column) -> Column:
    return F.shiftright(mark, 31)


def _place_of(mark: Column) -> Column:
    return (F.lit(_LAST) - mark.bitwiseAND(F.lit(_LAST))).cast("int")


def unpacked(marks: Column) -> Column:
    """array<struct<hash, position>>."""
    return F.transform(marks, lambda m: F.struct(_hash_of(m).alias("hash"), _place_of(m).alias("position")))


def as_text(marks: str) -> Column:
    """A fingerprint as text: ``hash:position`` of each mark, hashes in hexadecimal digits."""
    return F.array_join(F.transform(marks, lambda m: F.concat_ws(":", F.hex(m["hash"]), m["position"])), ",")


def likeness(left: Column, right: Column) -> Column:
    """Share of the distinct hashes of two packed fingerprints that are in both."""
    hashes = lambda marks: F.array_distinct(F.transform(marks, _hash_of))

    def of(a: Column, b: Column) -> Column:
        common = F.size(F.array_intersect(a, b))
        every = F.size(a) + F.size(b) - common
        return F.when(every == 0, F.lit(1.0)).otherwise(common / every)

    return _let(hashes(left), lambda a: _let(hashes(right), lambda b: of(a, b)))


def fingerprint(docs: DataFrame, text_col: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """``docs`` with ``marks``, an array of (hash, position)."""
    return docs.withColumn("marks", unpacked(packed_marks(F.col(text_col), gram, window)))


def _ordered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, down, tie): order columns of falling ids, apart from the caller's columns."""
    return docs.select(
        F.struct("*").alias("row"),
        F.bitwise_not(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))).alias("down"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tie"),
    )


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, text, packed, next_text, next_packed) of each document and the one with the next smaller id."""
    spark = docs.sparkSession
    rows = _ordered(docs, id_col, text_col)
    first = rows.agg(F.min(F.struct("down", "tie")).alias("first")).first().first
    if first is None:
        first = (0, 0)
    chunks = CHUNKS_A_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    borders = borders_of(rows, ["down", "tie"], chunks)
    # The first document of each chunk also stands behind the last one of the chunk before it.
    heads = local_frame(
        spark, [(*b, k) for k, b in enumerate([*borders.values, tuple(first)])], "down bigint, tie bigint, chunk int"
    )
    ahead = rows.join(F.broadcast(heads), ["down", "tie"]).dropDuplicates(["down", "tie", "chunk"])
    columns = ["row", "down", "tie", "chunk"]
    own = rows.withColumn("chunk", chunk_of([F.col("down"), F.col("tie")], borders)).select(*columns, F.lit(0).alias("ahead"))
    dealt = own.unionByName(ahead.select(*columns, F.lit(1).alias("ahead"))).repartition("chunk")
    # Only the rows are shuffled; texts and marks are taken from them behind the shuffle.
    texts = dealt.withColumn("text", F.coalesce(F.col("row")[text_col], F.lit("")))
    marked = texts.withColumn("packed", packed_marks(F.col("text")))
    order = Window.partitionBy("chunk").orderBy("ahead", "down", "tie")
    following = marked.withColumns({"next_text": F.lead("text").over(order), "next_packed": F.lead("packed").over(order)})
    return following.where("ahead = 0").select("row", "text", "packed", "next_text", "next_packed")


def compare_with_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document.

    In the edited text the last half of the characters (rounded down) is replaced by as many
    first characters of the next document, or by all it has.
    """
    kept = [c for c in docs.columns if c.lower() not in _NEW]
    n, half = F.char_length("text"), F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    both = with_next(docs, id_col, text_col).withColumn("edited_text", edited)
    found = both.withColumn("edited_packed", packed_marks(F.col("edited_text")))
    return found.select(
        *[F.col("row")[c].alias(c) for c in kept],
        n.cast("long").alias("n_chars"),
        unpacked(F.col("packed")).alias("marks"),
        "edited_text",
        unpacked(F.col("edited_packed")).alias("edited_marks"),
        likeness(F.col("packed"), F.col("edited_packed")).alias("near_edited"),
        likeness(F.col("packed"), F.col("next_packed")).alias("near_next"),
    )
