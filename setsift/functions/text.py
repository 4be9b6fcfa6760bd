"""Text and term expressions, all built from Spark SQL functions (no Python UDF).

Whitespace is matched with the Unicode flag ``(?U)`` so that, e.g., the ideographic
space U+3000 counts as whitespace, as it does in Python.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import col
from .. import constants as K

WS = r"(?U)\s+"


def _c(x: Column | str) -> Column:
    return col(x) if isinstance(x, str) else x


def normalize_text(text: Column | str) -> Column:
    """Missing -> "", lower case, whitespace runs -> one space, trimmed."""
    t = F.coalesce(_c(text).cast("string"), F.lit(""))
    return F.trim(F.regexp_replace(F.lower(t), WS, " "))


def words(text: Column | str) -> Column:
    """Whitespace-separated words (no empty strings)."""
    return F.filter(F.split(_c(text), WS), lambda w: w != F.lit(""))


def word_count(text: Column | str) -> Column:
    return F.size(words(F.coalesce(_c(text).cast("string"), F.lit(""))))


def is_blank(text: Column | str) -> Column:
    """NULL, or empty / "nan" / "None" after trimming."""
    markers = "|".join(re.escape(m) for m in K.EMPTY_MARKERS)
    return _c(text).isNull() | _c(text).cast("string").rlike(rf"(?U)\A\s*(?:{markers})\s*\z")  # texts are not rewritten


def latin_words(norm_text: Column) -> Column:
    """Words of 3+ characters starting with a letter (letters, '_' and '-')."""
    return F.regexp_extract_all(F.lower(norm_text), F.lit(K.LATIN_WORD_PATTERN), 0)


def _ngrams_of(s: Column, n_min: int, n_max: int) -> Column:
    """All substrings of length n_min..n_max of s, by length then position."""
    def of_length(n: int) -> Column:
        # sequence(1, 0) counts down, so runs shorter than n are guarded explicitly
        starts = F.sequence(F.lit(1), F.length(s) - F.lit(n - 1))
        grams = F.transform(starts, lambda i: F.substring(s, i, n))
        return F.when(F.length(s) >= F.lit(n), grams).otherwise(F.array().cast("array<string>"))

    return F.concat(*[of_length(n) for n in range(n_min, n_max + 1)])


def han_ngrams(norm_text: Column) -> Column:
    """2..4-grams of every run of CJK unified ideographs (runs shorter than n give none)."""
    runs = F.regexp_extract_all(norm_text, F.lit(K.HAN_RUN_PATTERN), 0)
    return F.flatten(F.transform(runs, lambda r: _ngrams_of(r, K.HAN_NGRAM_MIN, K.HAN_NGRAM_MAX)))


def explanation_terms(text: Column | str) -> Column:
    """Latin words then Han n-grams of the normalised text, stop words and 1-char terms removed."""
    norm = normalize_text(text)
    stop = F.array(*[F.lit(w) for w in K.STOPWORDS])
    terms = F.concat(latin_words(norm), han_ngrams(norm))
    return F.filter(terms, lambda t: (F.length(F.trim(t)) >= F.lit(2)) & ~F.array_contains(stop, t))


def longest_first(terms: Column, limit: int | None = None) -> Column:
    """Sort by length descending, then alphabetically; optionally keep the first ``limit``."""
    keyed = F.sort_array(F.transform(terms, lambda t: F.struct((-F.length(t)).alias("k"), t.alias("t"))))
    out = F.transform(keyed, lambda s: s["t"])
    return F.slice(out, 1, limit) if limit else out


def shared_terms(text_terms: Column, prototype_terms: Column, limit: int = K.MAX_MATCHED_TERMS) -> Column:
    """Distinct terms in both lists, longest first then alphabetical, at most ``limit``."""
    return longest_first(F.array_intersect(F.array_distinct(text_terms), F.array_distinct(prototype_terms)), limit)


def char_wb_ngrams(text: Column | str, n_min: int = K.NGRAM_MIN, n_max: int = K.NGRAM_MAX) -> Column:
    """Character n-grams inside word boundaries: every lower-cased word padded with one
    space on each side contributes all of its n-grams, n = n_min..n_max."""
    t = F.lower(F.coalesce(_c(text).cast("string"), F.lit("")))
    padded = F.transform(words(t), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    return F.flatten(F.transform(padded, lambda p: _ngrams_of(p, n_min, n_max)))
