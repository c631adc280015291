"""The token relation in the JVM alone, for what needs a token's place, kind and text and no more."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.plans.grammar import STATIC, TOKEN, WHOLE


def literals(text: Column) -> Column:
    """A text's tokens as an array of strings that join to the text; an error is one last string."""
    return F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(0))


def _kind(literal: Column, may_fail: Column) -> Column:
    first = F.substring(literal, 1, 1)
    out = F.when(may_fail & ~literal.rlike(WHOLE), "Err").when(first == '"', "Str")
    for kind, text in STATIC.items():
        out = out.when(first == text[0], kind)
    return out.when(first.isin(" ", "\t", "\n", "\r"), "White").otherwise("Num")


def token_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row per token: docs' other columns, i, kind and literal, lexed but not held against the grammar.

    The generator takes the array where it is made, so the text is lexed once.  Null and empty texts give no rows.
    """
    rest = [f"`{c}`" for c in docs.columns if c != text]
    rows = docs.select(*rest, F.octet_length(text).alias("_size"), F.posexplode(literals(F.col(text))).alias("i", "literal"))
    # an error is a text's last token; only a token that isn't one character can be one, but for what starts none
    rows = rows.withColumn("kind", _kind(F.col("literal"), ~F.col("literal").isin("{", "}", "[", "]", ":", ",", " ")))
    return rows.select(*rest, F.col("i").cast("long"), "kind", "literal")
