"""Quality rules, line first: lines that fail a rule go, documents that lose too much text go with them.

DataFrame functions only.  Nothing is shuffled: every figure comes from the row's own text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import WORD, in_place, whole_text

SYMBOLS = r"[#*$%&|<>]"
#: Marks that end a sentence or a clause; closing quotes and brackets may follow.  A line of prose has one
#: somewhere, be it cut off in the middle of its last sentence.
ENDS = r"[.!?…:;,][\"'”’»)\]]*(?:\s|$)|[。！？]"
#: The same at a line's end.
LAST = r"(?:[.!?…:;,][\"'”’»)\]]*|[。！？])\s*$"
#: Marks between the entries of a navigation bar.
BARS = r"[|»›•·]"
#: Phrases of page furniture in English, German, French and Spanish; a short line that holds one is furniture.
BOILERPLATE = (
    r"(?i)\b(?:cookies? (?:policy|settings)|accept (?:all )?cookies|privacy policy|terms of (?:use|service)|all rights reserved|enable javascript|lorem ipsum|click here|read more|sign (?:in|up)|log in|subscribe to our|share on"
    r"|alle rechte vorbehalten|datenschutzerkl[äÄ]rung|cookies akzeptieren|allgemeine gesch[äÄ]ftsbedingungen|hier klicken|weiterlesen|jetzt anmelden|newsletter abonnieren|teilen auf"
    r"|tous droits r[éÉ]serv[éÉ]s|politique de confidentialit|accepter (?:tous )?les cookies|mentions l[éÉ]gales|conditions d.utilisation|cliquez ici|lire la suite|se connecter|partager sur"
    r"|todos los derechos reservados|pol[íÍ]tica de (?:privacidad|cookies)|aceptar (?:todas )?las cookies|aviso legal|t[éÉ]rminos de uso|haga clic|leer m[áÁ]s|iniciar sesi[óÓ]n|compartir en)"
    r"|copyright (?:©|\(c\))|© ?[12][0-9]{3}"
)
#: Words of the longest line that a phrase fails.
SHORT = 12
#: Words of the longest line of a menu, and how many such lines in a row are one.
ENTRY, MENU = 3, 3
WINDOW = 5
MAX_LOST = 0.5


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(0))


def repeated_words(df: DataFrame, words_column: str, out: str, window: int = WINDOW) -> DataFrame:
    """Adds how many words lie in a window of words found twice or more in the row.

    Windows are hashed first, and only rows in which two hashes agree compare the windows' words: equal
    windows never differ in their hash, so no repeat is missed, and a chance agreement is put right there.
    """
    w = F.col(words_column)
    last = F.size(w) - window
    places = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(places, lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(window))))
    df = df.withColumn("_hashes", hashes)
    again = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    ordered = F.array_sort(F.transform(places, lambda i: F.struct(F.array_join(F.slice(w, i + 1, window), " ").alias("k"), i.alias("i"))))
    df = df.withColumn("_ordered", F.when(again, ordered))
    o = F.col("_ordered")
    same = lambda j, k: F.coalesce(F.get(o, j)["k"] == F.get(o, k)["k"], F.lit(False))
    twice = F.filter(F.transform(o, lambda x, j: F.when(same(j, j - 1) | same(j, j + 1), x["i"])), lambda x: x.isNotNull())
    df = df.withColumn("_twice", F.array_sort(twice))
    covered = F.aggregate(
        "_twice",
        F.struct(F.lit(-window).alias("at"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(x.alias("at"), (a["n"] + F.least(F.lit(window), x - a["at"])).alias("n")),
        lambda a: a["n"],
    )
    return df.withColumn(out, F.coalesce(covered, F.lit(0).cast("long"))).drop("_hashes", "_ordered", "_twice")


def _count(line: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(line, F.lit(f"({pattern})"), F.lit(0)))


def line_fails(line: Column) -> Column:
    """True for a line of three words or more in which no sentence or clause ends, that is a navigation bar (of marks, or of
    entries between commas without an end), that shouts symbols, or, being short, holds a phrase of page furniture.

    Conditions that most lines fail come first, so that the rest is seldom looked at.
    """
    n_words = _count(line, WORD)
    bars, symbols, shouts, commas = (_count(line, x) for x in (BARS, SYMBOLS, "!", ","))
    marked = (bars >= 3) & (n_words <= 5 * (bars + 1)) | (symbols >= 3) & (symbols * 3 >= n_words) | (shouts >= 4) & (shouts * 3 >= n_words)
    brief = F.length(line) <= 40 * SHORT
    listed = ~line.rlike(LAST) & (commas >= 2) & (n_words <= 2 * (commas + 1))
    furniture = (n_words <= SHORT) & line.rlike(BOILERPLATE)
    return ~line.rlike(ENDS) & (n_words >= 3) | line.rlike(r"[|»›•·#*$%&<>!]") & marked | brief & (listed | furniture)


def menu_entry(line: Column) -> Column:
    """A line of one to three words without an end mark."""
    return (F.length(line) <= 40 * ENTRY) & line.rlike(WORD) & ~line.rlike(LAST) & (_count(line, WORD) <= ENTRY)


def _in_menu(entries: str, i: Column) -> Column:
    """Whether line i is one of MENU entries in a row; entries: a flag a line."""
    at = lambda k: F.coalesce(F.get(F.col(entries), i + k), F.lit(False))  # noqa: E731  null outside, below 0 too
    return at(0) & (at(1) & at(2) | at(-1) & at(1) | at(-1) & at(-2))


_ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "cleaned", "n_repeat_words", "base_failed", "lost_chars", "kept")


def assessed(docs: DataFrame, max_lost: float = MAX_LOST) -> DataFrame:
    """(doc_id, text, ...) -> every row with its figures, cleaned text and verdict.

    Adds n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word that equal an
    earlier one), n_repeat_words (words in 5-word windows found twice or more), base_failed (under 10 words,
    or over a fifth of them repeated), lost_chars (code points other than blanks in failed lines),
    cleaned (the text without failed lines) and kept (false if base_failed or if failed lines hold over
    max_lost of what isn't blank).  A line fails by `line_fails`, or as one of three menu entries in a row.
    Null text counts as empty: no words, base_failed.  Repeated rows and null ids stay as they are, no rows
    give none, and columns of docs named like these are an error.
    """
    if clash := {*_ADDED, "_text", "_words", "_lines", "_good", "_worded", "_entries"} & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns named {sorted(clash)}: rename them first")
    df = docs.withColumn("_text", whole_text()).withColumn("_words", words(F.col("_text")))
    df = df.withColumn("_lines", F.split("_text", "\n"))
    df = df.withColumn("_entries", F.transform("_lines", menu_entry))
    df = df.withColumn("_good", F.filter("_lines", lambda x, i: ~(x.rlike(WORD) & (_in_menu("_entries", i) | line_fails(x)))))
    df = df.withColumn("_worded", F.filter("_lines", lambda x: x.rlike(WORD)))
    chars = lambda w: F.length(F.array_join(w, "")).cast("long")
    df = df.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": chars("_words"),
        "n_symbols": _count(F.col("_text"), SYMBOLS).cast("long"),
        "n_dup_lines": (F.size("_worded") - F.size(F.array_distinct("_worded"))).cast("long"),
        "cleaned": F.array_join("_good", "\n"),
    })
    df = repeated_words(df, "_words", "n_repeat_words")
    lost = F.when(F.size("_good") < F.size("_lines"), F.col("word_chars") - chars(words(F.col("cleaned")))).otherwise(F.lit(0).cast("long"))
    df = df.withColumns({"base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")), "lost_chars": lost})
    kept = ~F.col("base_failed") & (F.col("lost_chars") <= max_lost * F.col("word_chars"))
    return df.withColumn("kept", kept).drop("_text", "_words", "_lines", "_good", "_worded", "_entries")


def figures(docs: DataFrame, max_lost: float = MAX_LOST) -> DataFrame:
    """A row per document: doc_id, the figures of `assessed`, base_failed and kept."""
    out = assessed(docs.select("doc_id", "text"), max_lost)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_chars", "kept")


def cleaned_documents(docs: DataFrame, max_lost: float = MAX_LOST) -> DataFrame:
    """The kept documents with their failed lines removed, in the columns of docs (n_chars follows the text)."""
    out = assessed(docs.select(F.struct(*docs.columns).alias("_row"), F.col("text")), max_lost)
    out = out.withColumn("_stays", in_place(F.col("kept"))).where("_stays")
    fresh = {"text": F.col("cleaned")} | ({"n_chars": F.length("cleaned").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*(fresh.get(c, F.col("_row")[c]).alias(c) for c in docs.columns))
