"""Line-first cleaning, in DataFrame functions only.

Lines are judged one by one by rules on punctuation, navigation and boilerplate; failed
lines are removed, and a text that loses too much of itself, or that fails the base
rules, is rejected.  Everything happens inside the row: no shuffle, so no key can be hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50  # of the words, inside three-word windows that occur again
MAX_LOST_PERCENT = 40  # of the words, in removed lines

# A line ends like a sentence, or is a heading or list entry of some length.
SENTENCE_END = r"""[.!?…:;。！？]["'”’»)\]]*[\x20\x09-\x0D]*$"""
MIN_OPEN_WORDS = 3
# A menu: three separators or more that pair with no opening mark, and few words to each of them ...
MENU_SEPARATOR = r"[|»›•·>]"
OPENING_MARK = r"[«‹<]"  # quotation marks and tags open with these: what they pair with separates nothing
MIN_SEPARATORS = 3
MENU_WORDS = 5  # to a separator, separators that stand alone included
# ... or nothing but the words of a menu.
MENU_LINE = (
    r"(?i)^[\x20\x09-\x0D]*(home|menu|search|log ?in|sign ?(in|up)|share|next|previous|back|read more|subscribe|about us|contact us"
    r"|register|back to top|skip to content)[\x20\x09-\x0D:.!»>]*$"
)
# Phrases of page furniture fail a line of which they are a good part.
PHRASE_WORDS = 12  # to a phrase
BOILERPLATE = (
    r"(?i)(^|[^\p{L}\p{N}_])(cookie policy|use(s)? (of )?cookies|accept cookies|privacy policy|terms of (use|service)|all rights reserved"
    r"|enable javascript|lorem ipsum|powered by|click here|page not found|copyright ©|share this|follow us)([^\p{L}\p{N}_]|$)"
)


def _staged(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row: a generator is a border the optimizer keeps."""
    return df.select("*", F.inline(F.array(F.struct(*[value.alias(name) for name, value in columns.items()]))))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def line_fails(line: Column) -> Column:
    """Whether a line with at least one word is removed.

    Separators and phrases are held against the words of the line, so a paragraph that quotes in
    guillemets or mentions a privacy policy stays.
    """
    words = F.regexp_count(line, F.lit(WORD))
    few = (words < MIN_OPEN_WORDS) & ~line.rlike(SENTENCE_END)
    loose = F.regexp_count(line, F.lit(MENU_SEPARATOR)) - F.regexp_count(line, F.lit(OPENING_MARK))
    menu = (loose >= MIN_SEPARATORS) & (words <= MENU_WORDS * loose)
    furniture = line.rlike(BOILERPLATE) & (words <= PHRASE_WORDS * F.regexp_count(line, F.lit(BOILERPLATE)))
    return few | menu | line.rlike(MENU_LINE) | furniture


def _repeated_words() -> tuple[str, Column, Column, Column]:
    """Steps to the words covered by windows that occur twice or more, from the hashes ``h`` of
    the windows in order.

    Hash and place of a window share one long, so that a sort of longs brings equal
    windows together; the full hashes decide.
    """
    shift = "cast(length(bin(size(h))) as int)"
    packed = f"transform(h, (x, i) -> shiftleft(x, {shift}) | cast(i as bigint))"
    place = f"cast(x & (shiftleft(1L, {shift}) - 1) as int)"
    twin = lambda step: (
        f"h[{place}] = h[cast(get(s, i {step}) & (shiftleft(1L, {shift}) - 1) as int)]"
    )
    again = F.expr(f"filter(s, (x, i) -> coalesce({twin('- 1')}, false) or coalesce({twin('+ 1')}, false))")
    places = F.expr(f"sort_array(transform(d, x -> {place}))")
    covered = F.expr(
        "aggregate(p, struct(-3 as last, 0L as n), (a, x) -> struct(x as last, a.n + least(3, x - a.last) as n), a -> a.n)"
    )
    return packed, again, places, covered


def measure(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``doc`` (the whole row as a struct), its measures, verdict and cleaned text.

    Null and empty texts have no words: all counts are 0 and the base rules fail.  Rows
    are judged one by one, so repeated rows, null ids and extra columns change nothing.
    """
    packed, again, places, covered = _repeated_words()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    rows = _staged(rows, text=F.coalesce(F.col("doc").getField(text_column).cast("string"), F.lit("")))
    rows = _staged(rows, words=words_of(F.col("text")), lines=F.split("text", "\n", -1))
    rows = _staged(
        rows,
        n_words=F.size("words").cast("long"),
        word_chars=F.length(F.array_join("words", "")).cast("long"),
        n_symbols=F.regexp_count("text", F.lit(SYMBOL)).cast("long"),
        filled=F.filter("lines", lambda x: x.rlike(WORD)),
        h=F.when(
            F.size("words") >= 3,
            F.expr("transform(sequence(0, size(words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2]))"),
        ).otherwise(F.expr("cast(array() as array<bigint>)")),
    ).drop("words")
    rows = _staged(
        rows,
        n_dup_lines=(F.size("filled") - F.size(F.array_distinct("filled"))).cast("long"),
        bad=F.filter(F.array_distinct("filled"), line_fails),
        s=F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.expr(packed))),
    ).drop("filled")
    rows = _staged(rows, d=F.when(F.col("s").isNotNull(), again)).drop("s")
    rows = _staged(rows, p=F.when(F.col("d").isNotNull(), places))
    rows = _staged(
        rows,
        n_repeat_words=F.coalesce(covered, F.lit(0)).cast("long"),
        lost=F.when(F.size("bad") == 0, F.lit(0)).otherwise(
            F.regexp_count(F.array_join(F.filter("lines", lambda x: F.array_contains("bad", x)), "\n"), F.lit(WORD))
        ),
    ).drop("h", "d", "p")
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = rows.withColumn("base_failed", base)
    verdict = ~F.col("base_failed") & (100 * F.col("lost") <= MAX_LOST_PERCENT * F.col("n_words"))
    cleaned = F.when(F.size("bad") == 0, F.col("text")).otherwise(
        F.array_join(F.filter("lines", lambda x: ~F.array_contains("bad", x)), "\n")
    )
    return rows.select(
        "doc", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", verdict.alias("kept"),
        F.col("lost").cast("long").alias("n_lost_words"), cleaned.alias("cleaned"),
    )


def quality(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Measures and verdict of each row."""
    return measure(docs, text_column).select(
        F.col("doc").getField(id_column).alias(id_column), "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", "base_failed", "kept", "n_lost_words",
    )


def clean(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The kept rows with all their columns; removed lines are gone from the text, and
    ``n_chars``, where there is one, counts the new text."""
    kept = measure(docs, text_column).where("kept")
    new = {text_column: F.col("cleaned")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("cleaned").cast(docs.schema["n_chars"].dataType)
    return kept.select(*[new.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns])
