"""Columns over text: tokens, numbers, keys, overlap."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[a-z0-9_à-öø-ÿğışœ]+"
QUESTION_WORDS = ("what", "which", "how", "where", "when", "why", "who", "is", "are", "the", "a", "an", "of", "for", "in")


def folded(text: Column) -> Column:
    """Lower case, with the dotted capital I folded first."""
    return F.lower(F.regexp_replace(text, "İ", "i"))


def tokens(text: Column, protected: tuple[str, ...] = ()) -> Column:
    """Tokens in order; protected terms of several words become one token joined by underscores.  Null text has none."""
    low = folded(F.coalesce(text, F.lit("")))
    for term in protected:
        low = F.replace(low, F.lit(term), F.lit(term.replace(" ", "_")))
    return F.regexp_extract_all(low, F.lit(TOKEN), F.lit(0))


def ngrams(words: Column, n: int) -> Column:
    """Runs of n neighbouring tokens, joined by underscores."""
    at = F.sequence(F.lit(1), F.size(words) - n + 1)
    return F.when(F.size(words) >= n, F.transform(at, lambda i: F.array_join(F.slice(words, i, n), "_"))).otherwise(F.array().cast("array<string>"))


def number(text: Column) -> Column:
    """A number from text, with a comma or a point; null if it isn't one."""
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def overlap_ratio(a: Column, b: Column) -> Column:
    """Shared distinct words over the larger set; 0 if both are empty."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    most = F.greatest(F.size(x), F.size(y))
    return F.when(most > 0, F.size(F.array_intersect(x, y)) / most).otherwise(F.lit(0.0))


def query_pattern(query: Column, words: int = 4) -> Column:
    """The first words of a query once question words are gone."""
    kept = F.filter(tokens(query), lambda w: ~w.isin(*QUESTION_WORDS))
    return F.array_join(F.slice(kept, 1, words), " ")


def source_ref(file_name: Column, section: Column) -> Column:
    """File name without extension and blanks, and its section."""
    return F.concat_ws("#", F.regexp_replace(F.regexp_replace(file_name, r"\.[A-Za-z0-9]+$", ""), " ", ""), section)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 where either has no length."""
    add = lambda s, x: s + x
    zero = F.lit(0.0)
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), zero, add)
    norm = lambda v: F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), zero, add))
    length = norm(a) * norm(b)
    return F.when(length > 0, dot / length).otherwise(zero)


def severity(percent: Column) -> Column:
    return F.when(percent > 50, "critical").when(percent > 20, "high").when(percent > 10, "medium").otherwise("low")


def cache_key(query: Column, filters: Column) -> Column:
    """SHA-256 of the normalised query and its filters."""
    return F.sha2(F.concat_ws("|", F.lower(F.trim(query)), F.coalesce(filters, F.lit(""))).cast("binary"), 256)
