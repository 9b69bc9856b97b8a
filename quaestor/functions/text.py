"""Text columns: ids, cleaning, counts, tokens and overlap scores, all from built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What divides tokens. Marks belong to letters, so decomposed accents stay in their word.
NO_TOKEN = r"[^\p{L}\p{N}\p{M}]+"


def uid(kind: str, key: Column) -> Column:
    """An id that reruns agree on: the MD5 of kind and natural key, with hyphens."""
    h = F.md5(F.encode(F.concat(F.lit(kind + ":"), key.cast("string")), "UTF-8"))
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def clean(raw: Column) -> Column:
    """Markup and entities to blanks, then runs of white space to one blank, none at the ends."""
    no_tags = F.regexp_replace(F.regexp_replace(raw, r"<[^>]*>", " "), r"&[A-Za-z]+;|&#[0-9]+;", " ")
    return F.trim(F.regexp_replace(no_tags, r"[ \t\r\n]+", " "))


def rewrite(query: Column) -> Column:
    """A query in lower case without superfluous white space."""
    return F.lower(F.trim(F.regexp_replace(query, r"[ \t\r\n]+", " ")))


def char_count(text: Column) -> Column:
    return F.length(text)


def word_count(text: Column) -> Column:
    """Runs without white space; none in a blank text."""
    trimmed = F.regexp_replace(text, r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[ \t\r\n]+")))


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), NO_TOKEN), lambda t: t != "")


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def coverage(wanted: Column, found: Column) -> Column:
    """Share of the tokens `wanted` that are among `found`; null where nothing is wanted."""
    return F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, found)) / F.size(wanted))


def f1(a: Column, b: Column) -> Column:
    """F1 of two token sets: twice the shared over the sum of sizes."""
    both = F.size(a) + F.size(b)
    return F.when(both > 0, 2 * F.size(F.array_intersect(a, b)) / both)
