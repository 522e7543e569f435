"""Scalar text functions: normalisation, tokens, n-grams and token-set measures, all JVM-side columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as a Unicode-aware split() sees it; Java's \s has no non-breaking space.
WHITE = r"[\t-\r\x1c-\x20\x85\p{Z}]+"


def normalize(c: Column) -> Column:
    """White space runs to one space, trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), WHITE, " "))


def stripped(c: Column) -> Column:
    """Without the white space at both ends; null is empty."""
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), f"^{WHITE}|{WHITE}$", "")


def blank(c: Column) -> Column:
    """Whether a value is null or nothing but white space."""
    return normalize(c) == ""


def product_text(*fields: Column) -> Column:
    """The normalised fields that are not empty, in order, joined by a space (concat_ws keeps empty strings, so nullif)."""
    return F.concat_ws(" ", *[F.nullif(normalize(f), F.lit("")) for f in fields])


def feature_tokens(c: Column) -> Column:
    """Lower-case runs of a-z and 0-9, repeats kept."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def index_tokens(c: Column) -> Column:
    """Lower-case words of two or more letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value taken once however often use names it: it is the one element of an array there. What is named
    several times below a lambda is otherwise taken anew each time."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def ngrams(tokens: Column, low: int = 1, high: int = 2) -> Column:
    """All runs of low..high tokens joined by a space, shorter ones first."""

    def of(t: Column, n: int) -> Column:
        count = F.greatest(F.size(t) - (n - 1), F.lit(0))
        return reduce(lambda left, k: F.zip_with(left, F.slice(t, F.lit(k + 1), count), lambda a, b: F.concat(a, F.lit(" "), b)), range(1, n), F.slice(t, F.lit(1), count))

    return once(tokens, lambda t: F.concat(*[of(t, n) for n in range(low, high + 1)]))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def coverage(query: Column, document: Column) -> Column:
    """Share of the query's distinct tokens that the document has; 0 for a query without tokens."""
    own = F.size(F.array_distinct(query))
    return F.when(own > 0, F.size(F.array_intersect(query, document)) / own).otherwise(F.lit(0.0))


def exact_phrase(query: Column, title: Column) -> Column:
    """1.0 where the query's tokens follow one another in the title (tokens hold no spaces, so this is exact)."""
    space = F.lit(" ")
    inside = F.contains(F.concat(space, F.array_join(title, " "), space), F.concat(space, F.array_join(query, " "), space))
    return F.when((F.size(query) > 0) & inside, F.lit(1.0)).otherwise(F.lit(0.0))


def matched_terms(query: Column, title: Column) -> Column:
    """The query's tokens that the title has, in the query's order, once each."""
    return F.array_intersect(query, title)


def short_description(c: Column, most: int = 240) -> Column:
    """Normalised, null if blank, cut to most characters with an ellipsis."""
    text = normalize(c)
    return F.when(text == "", F.lit(None)).when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, most - 3)), F.lit("...")))


def length_bucket(c: Column) -> Column:
    """1, 2, 3-4 or 5+ white-space tokens."""
    n = F.size(F.split(normalize(c), " "))
    return F.when(n <= 1, "1").when(n == 2, "2").when(n <= 4, "3-4").otherwise("5+")


def grade(label: Column, grades: dict[str, int]) -> Column:
    """The grade of a label; null for one that the mapping lacks."""
    return reduce(lambda c, x: c.when(label == x[0], F.lit(x[1])), grades.items(), F.when(F.lit(False), F.lit(0)))
