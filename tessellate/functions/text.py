"""Scalar text functions over columns: name sanitising, tokenising and phrasing. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sanitize(name: Column | str, collapse: bool = True) -> Column:
    """A name that is safe in an identifier: other signs than letters, digits and ``_`` become ``_``.

    With ``collapse``, runs of ``_`` are one, none is left at either end, and an empty name is ``unknown``.
    """
    name = _col(name)
    if not collapse:
        return F.regexp_replace(name, "[^A-Za-z0-9_]", "_")
    safe = F.regexp_replace(F.regexp_replace(name, r"^\s+|\s+$", ""), "[^A-Za-z0-9_]+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(safe, "_+", "_"), "^_|_$", ""), F.lit("")), F.lit("unknown"))


def local_name(*parts: Column | str) -> Column:
    """The sanitised parts joined by ``_``; null and empty parts are left out."""
    kept = [F.when(_col(p) != "", sanitize(p)) for p in parts]
    return F.concat_ws("_", *kept)


def split_case(name: Column | str) -> Column:
    """A space where a small letter meets a capital."""
    return F.regexp_replace(_col(name), "([a-z])([A-Z])", "$1 $2")


def split_acronyms(name: Column | str) -> Column:
    """``split_case``, and a space before the capital that begins a word after an acronym."""
    return F.regexp_replace(split_case(name), "([A-Z]+)([A-Z][a-z])", "$1 $2")


def _lowered(parts: Column) -> Column:
    return F.transform(F.filter(parts, lambda t: t != ""), lambda t: F.lower(t))


def case_tokens(name: Column | str) -> Column:
    """Lower-case tokens by case and by signs; acronyms stay with what follows them."""
    return _lowered(F.split(split_case(name), "[^A-Za-z0-9]+"))


def acronym_tokens(name: Column | str) -> Column:
    """Lower-case tokens by case, acronyms and signs."""
    return _lowered(F.split(split_acronyms(name), "[^A-Za-z0-9]+"))


def long_token_set(name: Column | str) -> Column:
    """The distinct ``acronym_tokens`` of two letters or more."""
    return F.array_distinct(F.filter(acronym_tokens(name), lambda t: F.length(t) > 1))


def spaced_tokens(name: Column | str, lower: bool = True) -> Column:
    """Tokens by case, acronyms and white space alone; signs stay in them."""
    parts = F.filter(F.split(split_acronyms(name), r"\s+"), lambda t: t != "")
    return F.transform(parts, lambda t: F.lower(t)) if lower else parts


def word_tokens(name: Column | str) -> Column:
    """Lower-case runs of letters by case; digits and signs are dropped."""
    return F.transform(F.regexp_extract_all(_col(name), F.lit("[A-Z]?[a-z]+|[A-Z]+(?=[A-Z]|$)"), F.lit(0)), lambda t: F.lower(t))


def phrase(name: Column | str) -> Column:
    """A name as lower-case words: BrakeRotor is ``brake rotor``, ECUModule is ``ecu module``."""
    return F.regexp_replace(F.lower(split_acronyms(name)), r"^\s+|\s+$", "")


def camel_words(name: Column | str) -> Column:
    """A name with a space before each capitalised word, lower-case, single spaces."""
    spaced = F.regexp_replace(_col(name), "([A-Z][a-z]+)", " $1")
    return F.regexp_replace(F.lower(F.regexp_replace(spaced, r"^\s+|\s+$", "")), r"\s+", " ")


def grams(text: Column | str, n: int = 3) -> Column:
    """The distinct character n-grams of a lower-case text; those shorter than n give their characters."""
    low = F.lower(_col(text))
    size = F.length(low)
    long_ = F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substring(low, i, F.lit(n)))
    short = F.filter(F.split(low, ""), lambda c: c != "")
    return F.array_distinct(F.when(size >= n, long_).otherwise(short))


def verb_phrase(association: Column | str, participants: Column | str) -> Column:
    """The words of an association's name that none of its participants' names hold; all words if none is left."""
    words = spaced_tokens(association)
    held = F.flatten(F.transform(_col(participants), lambda p: spaced_tokens(p)))
    left = F.filter(words, lambda w: ~F.array_contains(held, w))
    return F.array_join(F.when(F.size(left) > 0, left).otherwise(words), " ")


def about(name: Column | str, sentence: str = "This observable is about {}.") -> Column:
    """A template sentence for text-pair scorers."""
    before, _, after = sentence.partition("{}")
    return F.concat(F.lit(before), _col(name), F.lit(after))


def take(values: Column, n: int) -> Column:
    """The first n elements."""
    return F.slice(values, 1, n)
