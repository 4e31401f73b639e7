"""Labels of entities: normalisation, local names, tokens, n-grams and their similarities, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ASCII punctuation characters (fixed values).
PUNCTUATION = r"[!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"
CAMEL = "([a-z0-9])([A-Z])"


def normalize_label(text: Column) -> Column:
    """Trimmed, camel case split, ASCII punctuation to spaces, single spaces, lower case; null becomes empty."""
    t = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), CAMEL, "$1 $2")
    t = F.regexp_replace(t, PUNCTUATION, " ")
    return F.lower(F.trim(F.regexp_replace(t, r"(?U)\s+", " ")))


def normalize_label_unicode(text: Column) -> Column:
    """As `normalize_label`, but everything beyond Unicode letters, digits, `_` and white space becomes a space."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), CAMEL, "$1 $2")
    t = F.regexp_replace(F.translate(t, "_-", "  "), r"(?U)[^\w\s]", " ")
    return F.lower(F.trim(F.regexp_replace(t, r"(?U)\s+", " ")))


def local_name(iri: Column) -> Column:
    """What follows the last `#`, else the last path segment without trailing slashes."""
    return F.when(F.contains(iri, F.lit("#")), F.substring_index(iri, "#", -1)).otherwise(
        F.substring_index(F.rtrim(iri, F.lit("/")), "/", -1)
    )


def base_namespace(iri: Column) -> Column:
    """Through the last `#`; the whole IRI if it has none."""
    return F.when(F.contains(iri, F.lit("#")), F.regexp_extract(iri, "^(.*#)", 1)).otherwise(iri)


def iri_label(iri: Column) -> Column:
    """The last path segment without an `.owl` ending."""
    return F.regexp_replace(F.substring_index(F.rtrim(iri, F.lit("/")), "/", -1), r"(?i)\.owl$", "")


def tokens(text: Column) -> Column:
    """The words of a text between white space, in order."""
    return F.filter(F.split(text, " "), lambda t: t != "")


def word_tokens(text: Column) -> Column:
    """The runs of Unicode word characters, lower-cased, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"((?U)\w+)"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays as sets; 0 if either is empty."""
    inter, union = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(inter / union)


def ngrams(text: Column, n: int = 3) -> Column:
    """All substrings of length n in order; a shorter text is one gram, the empty text has none."""
    return (
        F.when(F.char_length(text) == 0, F.array().cast("array<string>"))
        .when(F.char_length(text) < n, F.array(text))
        .otherwise(F.transform(F.sequence(F.lit(1), F.char_length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n))))
    )


def hashed_vector(text: Column, size: int = 64) -> Column:
    """A vector of `size` numbers that counts the text's trigrams, each at a place that follows from its characters.

    Texts of fewer than three characters are filled up with spaces; the empty text is all zeros. It stands in for a
    learned embedding: texts with many trigrams in common have a high cosine."""
    filled = F.when(F.char_length(text).between(1, 2), F.rpad(text, 3, " ")).otherwise(text)
    code = lambda g, i: F.ascii(F.substring(g, i, 1))
    places = F.transform(ngrams(filled), lambda g: (code(g, 1) * 961 + code(g, 2) * 31 + code(g, 3)) % size)
    count = lambda own: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(own, lambda p: p == i)).cast("double"))
    return F.transform(F.array(places), count)[0]  # the places are worked out once


def bounded_levenshtein(a: Column, b: Column, most: int) -> Column:
    """The edit distance, or most + 1 where it is larger."""
    d = F.levenshtein(a, b, most)
    return F.when(d < 0, F.lit(most + 1)).otherwise(d)


def percent(part: Column, whole: Column) -> Column:
    """Null where there is no whole."""
    return F.when(whole != 0, part / whole * 100.0)


def ratio(part: Column, whole: Column) -> Column:
    """0 where there is no whole."""
    return F.when(whole != 0, part / whole).otherwise(F.lit(0.0))
