"""Line-first quality rules, in DataFrame functions only.

Each line is judged (punctuation, navigation, boilerplate, shouting, symbols, one word over and over, runs of
menu entries); failing lines go, and a document that loses too large a share of its words is rejected. Counts over
the whole text stand beside that. Everything happens inside a row: no shuffle, no state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS

BOILERPLATE = (
    r"all rights reserved|copyright|\(c\) \d{4}|©|cookie|privacy policy|terms of (use|service)|sign (in|up)|log ?in|"
    r"subscribe|javascript|click here|read more|lorem ipsum|licen[sc]ed under|released under|this work is licen[sc]ed"
)
#: What may end a sentence, quotes and brackets included.
END_CLASS = r"[.!?…:;,)\]\"'»”’。！？।؟]"
#: Signs that part the entries of a menu line, with white space on both sides.
MENU_SIGN = r"\s[|>/»›•·]\s"
SYMBOL_CLASS = r"[#*$%&|<>]+"
POSITION_BITS = 28


def space_words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+`; null: none."""
    return F.coalesce(F.array_remove(F.split(text, SPACE_CLASS), ""), F.array().cast("array<string>"))


def boilerplate_words(line: Column) -> Column:
    """Words in the sentences of a line that hold a boilerplate phrase."""
    told = F.filter(F.split(line, r"(?<=[.!?])\s+"), lambda s: s.rlike(f"(?i){BOILERPLATE}"))
    return F.size(F.array_remove(F.split(F.array_join(told, " "), SPACE_CLASS), ""))


def line_fails(line: Column, after: Column, symbol_share: float = 0.15, upper_share: float = 0.6, spread: float = 0.6, prose: int = 10) -> Column:
    """Whether a line with words breaks a rule; where a share is taken, lines of fewer than five words pass.

    Navigation: three or more bars, or three or more other menu signs. Punctuation: a line of `prose` words or
    more that no sentence mark ends, unless the line `after` goes on in lower case (a wrapped line); shorter ones
    may be headings. Boilerplate: half or more of a line of at most 30 words stands in sentences with such a phrase.
    Every pattern is a class or a fixed choice, so none recurses, however long the line.
    """
    words = F.array_remove(F.split(line, SPACE_CLASS), "")
    n = F.size(words)
    chars = F.length(line)
    symbols = chars - F.length(F.regexp_replace(line, SYMBOL_CLASS, ""))
    letters = F.length(F.regexp_replace(line, r"[^\p{L}]+", ""))
    capitals = F.length(F.regexp_replace(line, r"[^\p{Lu}]+", ""))
    wrapped = F.coalesce(after.rlike(r"^\s*\p{Ll}"), F.lit(False))
    return (
        (chars - F.length(F.translate(line, "|", "")) >= 3)
        | (F.size(F.split(line, MENU_SIGN)) > 3)
        | ((n >= prose) & ~line.rlike(END_CLASS + r"\s*$") & ~wrapped)
        | F.when((n <= 30) & line.rlike(f"(?i){BOILERPLATE}"), 2 * boilerplate_words(line) >= n).otherwise(False)
        | (symbols > symbol_share * F.greatest(chars, F.lit(1)))
        | (n >= 5) & (capitals > upper_share * F.greatest(letters, F.lit(1)))
        | (n >= 10) & (F.size(F.array_distinct(words)) < spread * F.sqrt(n.cast("double")))
    )


def menu_entry(line: Column) -> Column:
    """A line of at most three words that no sentence mark ends."""
    return (F.size(F.array_remove(F.split(line, SPACE_CLASS), "")) <= 3) & ~line.rlike(END_CLASS + r"\s*$")


def good_lines(lines: Column, entry: Column) -> Column:
    """The lines that break no rule; `entry` says of each whether it may be a menu entry, and three such in a row are a menu."""
    at = lambda i: F.coalesce(F.get(entry, i), F.lit(False))
    menu = lambda k: at(k) & ((at(k - 1) & (at(k - 2) | at(k + 1))) | (at(k + 1) & at(k + 2)))
    return F.filter(lines, lambda x, k: ~menu(k) & ~line_fails(x, F.get(lines, k + 1)))


def packed_shingles(codes: Column) -> Column:
    """Sorted longs, one for each three-word window: high bits of its hash, then its place."""
    n = F.size(codes)
    low = (1 << POSITION_BITS) - 1
    each = F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: F.xxhash64(F.get(codes, i), F.get(codes, i + 1), F.get(codes, i + 2)).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")))
    return F.sort_array(F.when(n >= 3, each).otherwise(F.array().cast("array<bigint>")))


def with_repeats(rows: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words in three-word windows that stand twice or more in the text.

    Windows with equal hash bits are the only ones compared by their words, and these are compared exactly.
    """
    low = (1 << POSITION_BITS) - 1
    high = lambda x: F.shiftright(x, POSITION_BITS)
    rows = rows.withColumn("_codes", F.transform("words", lambda w: F.xxhash64(w)))
    rows = rows.withColumn("_packed", packed_shingles(F.col("_codes"))).drop("_codes")
    alike = lambda x, k: F.coalesce(high(x) == high(F.get("_packed", k - 1)), F.lit(False)) | F.coalesce(high(x) == high(F.get("_packed", k + 1)), F.lit(False))
    rows = rows.withColumn("_alike", F.filter("_packed", alike)).drop("_packed")
    place = lambda x: x.bitwiseAND(F.lit(low)).cast("int")
    text = lambda p: F.concat_ws(" ", F.get("words", p), F.get("words", p + 1), F.get("words", p + 2))
    rows = rows.withColumn("_told", F.sort_array(F.transform("_alike", lambda x: F.struct(text(place(x)).alias("t"), place(x).alias("p"))))).drop("_alike")
    same = lambda s, k: F.coalesce(s["t"] == F.get("_told", k - 1)["t"], F.lit(False)) | F.coalesce(s["t"] == F.get("_told", k + 1)["t"], F.lit(False))
    rows = rows.withColumn("_at", F.sort_array(F.transform(F.filter("_told", same), lambda s: s["p"]))).drop("_told")
    covered = F.transform("_at", lambda p, k: F.coalesce(F.least(F.lit(3), F.get("_at", k + 1) - p), F.lit(3)))
    return rows.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0), lambda a, x: a + x)).drop("_at")


def judge_lines(docs: DataFrame, least_words: int = 50, most_repeated: int = 50, keep_share: float = 0.5) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept_share, cleaned, kept.

    `cleaned` is the text without its failing lines; lines without a word always stay. A document is kept
    if it passes the base rules (`least_words` words, at most `most_repeated` percent of them repeated) and
    its cleaned text has at least `keep_share` of its words. Null texts have no word, so they fail, as do
    empty ones. One row per input row; an empty table gives no rows; columns besides doc_id and text are
    ignored.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = own.withColumns({"words": space_words(F.col("text")), "lines": F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    rows = with_repeats(rows)
    rows = rows.withColumn("_entry", F.transform("lines", menu_entry))
    rows = rows.withColumn("good", good_lines(F.col("lines"), F.col("_entry")))
    whole = F.size("good") == F.size("lines")
    rows = rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", SPACE_CLASS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOL_CLASS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.col("n_repeat_words").cast("long").alias("n_repeat_words"),
        F.when(whole, F.col("text")).otherwise(F.array_join("good", "\n")).alias("cleaned"),
        whole.alias("_whole"),
    )
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    share = F.when(F.col("_whole"), F.lit(1.0)).otherwise(F.size(F.array_remove(F.split("cleaned", SPACE_CLASS), "")) / F.greatest("n_words", F.lit(1)))
    rows = rows.withColumns({"base_failed": failed, "kept_share": share})
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("kept_share") >= keep_share)).drop("_whole")
