"""Text as Column expressions: tokens, n-grams, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English function words; a term neither begins nor ends with one. Fixed values, version 1.
STOPWORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further "
    "had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own "
    "same she should so some such than that the their theirs them themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with would "
    "you your yours yourself yourselves"
).split()
#: Shortest term, in UTF-8 bytes.
SHORTEST = 3


def tokens(text: Column) -> Column:
    """Words between white space (Unicode), without marks at their ends, lower-cased, empty ones dropped."""
    parts = F.split(text, r"(?U)\s+")
    bare = F.transform(parts, lambda t: F.lower(F.regexp_replace(t, r"^[^\p{IsAlphabetic}\p{N}]+|[^\p{IsAlphabetic}\p{N}]+$", "")))
    return F.filter(bare, lambda t: t != "")


def _shifted(words: Column, n: int) -> Column:
    return F.slice(words, F.lit(n + 1), F.greatest(F.size(words) - n, F.lit(0)))


def ngrams(words: Column, max_n: int, stopwords: list[str] | None = None) -> Column:
    """Distinct n-grams of an array of words, n from 1 to max_n, that neither begin nor end with a stop word and have SHORTEST bytes or more.

    One flat zip per n: no lambda runs inside another, and nothing is shuffled to make a chunk's terms distinct.
    """
    stop = stopwords if stopwords is not None else STOPWORDS
    pieces, grams = [], words
    for n in range(1, max_n + 1):
        if n > 1:
            grams = F.zip_with(F.slice(grams, F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(0))), _shifted(words, n - 1), lambda a, b: F.concat_ws(" ", a, b))
        last = _shifted(words, n - 1)
        first = F.slice(words, F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(0)))
        ends = first if n == 1 else F.zip_with(first, last, lambda a, b: F.when(a.isin(*stop) | b.isin(*stop), F.lit("")).otherwise(F.lit("+")))
        if n == 1:
            pieces.append(F.filter(grams, lambda g: ~g.isin(*stop) & (F.octet_length(g) >= SHORTEST)))
        else:
            pieces.append(F.filter(F.zip_with(grams, ends, lambda g, e: F.when(e == "+", g)), lambda g: g.isNotNull() & (F.octet_length(g) >= SHORTEST)))
    return F.array_distinct(F.flatten(F.array(*pieces)))


def valid_name(proposed: Column, raw_term: Column) -> Column:
    """The trimmed, lower-cased name, or the raw term if the name has more than 4 words or more than 40 bytes."""
    name = F.lower(F.regexp_replace(proposed, r"(?U)^\s+|\s+$", ""))
    words = F.size(F.filter(F.split(name, r"(?U)\s+"), lambda w: w != ""))
    return F.when((words > 4) | (F.octet_length(name) > 40), raw_term).otherwise(name)
