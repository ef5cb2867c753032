"""Text functions: stripping, query normalization, tokens, documents from fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that the tokenizer drops.
STOPWORDS = ["the", "is", "in", "and", "to", "of", "a", "that", "it", "with", "as", "for", "was", "on", "by", "this", "are", "be", "or", "from"]


def strip(c: Column) -> Column:
    """Without white space at either end (trim() takes off spaces alone)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def normalize_query(c: Column) -> Column:
    return F.lower(strip(c))


def tokenize(c: Column) -> Column:
    """Lower-case ASCII words of two characters or more that are no stop words, in order, with repeats."""
    words = F.split(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "), " ")
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(STOPWORDS))


def token_columns(c: Column) -> dict[str, Column]:
    """tokens (null where there are none), token_string and token_count."""
    t = tokenize(c)
    return {"tokens": F.when(F.size(t) > 0, t), "token_string": F.array_join(t, " "), "token_count": F.size(t)}


def tokenized(rows: DataFrame, column: str) -> DataFrame:
    """rows with token_columns; a text is split once for all of them."""
    split = rows.withColumn("_tokens", tokenize(F.col(column)))
    t = F.col("_tokens")
    return split.withColumns({"tokens": F.when(F.size(t) > 0, t), "token_string": F.array_join(t, " "), "token_count": F.size(t)}).drop("_tokens")


def sentence_part(c: Column) -> Column:
    return F.when(c != "", F.concat(c, F.lit("\n"))).otherwise("")


def word_part(c: Column) -> Column:
    return F.when(c != "", F.concat(c, F.lit(", "))).otherwise("")


def list_part(c: Column) -> Column:
    return F.when(F.size(c) > 0, F.concat(F.array_join(c, ", "), F.lit("\n"))).otherwise("")


def combine(parts: list[Column]) -> Column:
    """The document of a collection: its parts one after the other, stripped; null where nothing is left."""
    return blank_to_null(strip(F.concat(*(F.coalesce(p, F.lit("")) for p in parts))))
