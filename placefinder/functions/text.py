"""Text functions, Column to Column; all of them run inside the JVM."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .refdata import DIRECTIONS, EXPANSIONS, NOT_SAINT, UNITS, suffix_variants

# Letters that fold to more than one letter, or that have no decomposition.
_LONG = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "TH"}
_SINGLE = {"ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "ł": "l", "Ł": "L", "ħ": "h", "Ħ": "H", "ı": "i", "ŧ": "t", "Ŧ": "T"}


@lru_cache(maxsize=1)
def _fold_table() -> tuple[str, str]:
    """Accented Latin letters and the letter each stands for, by canonical decomposition."""
    table = dict(_SINGLE)
    for a, z in ((0xC0, 0x250), (0x1E00, 0x1F00)):
        for code in range(a, z):
            plain = unicodedata.normalize("NFD", chr(code))
            if len(plain) > 1 and plain[0].isascii() and all(unicodedata.combining(c) for c in plain[1:]):
                table[chr(code)] = plain[0]
    return "".join(table), "".join(table.values())


def unaccent(text: Column) -> Column:
    out = F.translate(text, *_fold_table())
    for letter, plain in _LONG.items():
        out = F.replace(out, F.lit(letter), F.lit(plain))
    return out


def _words(text: Column) -> Column:
    """The words of a text of single blanks; none for the empty text."""
    return F.filter(F.split(text, " "), lambda w: w != "")


def raw_tokens(text: Column) -> Column:
    """Lower-case words without accents or punctuation, before abbreviations are expanded."""
    s = F.regexp_replace(F.lower(unaccent(text)), "['’]", "")
    return _words(F.trim(F.regexp_replace(s, "[^a-z0-9]+", " ")))


def norm_tokens(text: Column) -> Column:
    """Words of the canonical form: accents and punctuation gone, abbreviations expanded; ``st`` before a
    name is ``saint``, else ``street``."""
    expansions = F.create_map(*(F.lit(x) for pair in EXPANSIONS.items() for x in pair))
    words = raw_tokens(text)

    def expand(word: Column, following: Column) -> Column:
        saint = (word == "st") & following.rlike("^[a-z]") & ~following.isin(*NOT_SAINT)
        return F.when(F.coalesce(saint, F.lit(False)), F.lit("saint")).otherwise(F.coalesce(expansions[word], word))

    # Zipped with itself one word on (the last word's follower is null): a lambda that indexed ``words`` would
    # compute them again for every word. Read through a one-element array, they are computed once, not three times.
    return F.transform(F.array(words), lambda w: F.zip_with(w, F.slice(w, F.lit(2), F.size(w)), expand))[0]


def norm(text: Column) -> Column:
    return F.array_join(norm_tokens(text), " ")


def hn_int(number: Column) -> Column:
    """Leading one to seven digits of a house number, null without."""
    return F.nullif(F.regexp_extract(number, r"^\s*(\d{1,7})", 1), F.lit("")).cast("int")


def hn_norm(number: Column) -> Column:
    """A house number as it is compared: trimmed, lower case, without leading zeros."""
    return F.lower(F.regexp_replace(F.trim(number), "^0+([0-9])", "$1"))


def letters(text: Column) -> Column:
    """The letters in order: equal for anagrams."""
    return F.array_join(F.array_sort(F.split(F.lower(F.coalesce(text, F.lit(""))), "")), "")


def strip_trailing_state(text: Column, states: list[tuple[str, str]]) -> Column:
    """A canonical text without a trailing country and one of ``states`` (abbreviation, name); null if nothing is left."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"(\s+(us|usa|united states))?$", "")
    if states:
        names = "|".join(x.lower() for pair in states for x in pair)
        out = F.regexp_replace(out, rf"(\s+({names}))?$", "")
    return F.nullif(out, F.lit(""))


def ordered_trigrams(text: Column) -> Column:
    """Trigrams of each word, padded by two blanks before and one after, in order, with repeats."""
    grams = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    return F.flatten(F.transform(_words(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " ")), grams))


def trigrams(text: Column) -> Column:
    return F.array_distinct(ordered_trigrams(text))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common members of two arrays without repeats; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.coalesce(both / F.nullif(F.size(a) + F.size(b) - both, F.lit(0.0)), F.lit(0.0))


def similarity(a: Column, b: Column) -> Column:
    """Trigram similarity of two texts."""
    return jaccard(trigrams(a), trigrams(b))


def word_similarity(query_grams: Column, text_grams: Column) -> Column:
    """Greatest similarity of a query's trigrams to a run of a text's ordered trigrams. Runs that begin and end
    with a trigram of the query are enough: any other run has a better one inside it.

    Takes columns of trigrams (``trigrams``, ``ordered_trigrams``), as a lambda computes an expression again
    every time it is read.
    """
    places = F.filter(F.transform(text_grams, lambda g, i: F.when(F.array_contains(query_grams, g), i + 1)), lambda i: i.isNotNull())
    best_from = lambda a, ends: F.array_max(F.transform(F.filter(ends, lambda z: z >= a), lambda z: jaccard(query_grams, F.array_distinct(F.slice(text_grams, a, z - a + 1)))))
    best = F.transform(F.array(places), lambda ps: F.array_max(F.transform(ps, lambda a: best_from(a, ps))))[0]
    return F.coalesce(best, F.lit(0.0))


# -- postal forms --------------------------------------------------------------------------


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[key]


def postal_street(street: Column, suffixes: dict[str, str] | None = None) -> Column:
    """struct(predirectional, street_name, suffix, postdirectional, post_modifier) in postal abbreviations."""
    table = suffix_variants(suffixes)
    cleaned = F.trim(F.regexp_replace(F.regexp_replace(F.upper(unaccent(F.coalesce(street, F.lit("")))), "[.,'’#]", ""), r"\s+", " "))
    number = r"^\d+[A-Z]?$"
    is_suffix = lambda w: _lookup(table, w).isNotNull()

    def with_words(w: Column) -> Column:
        n = F.size(w)
        last, before, first = F.element_at(w, -1), F.get(w, n - 2), F.get(w, F.lit(0))
        after = _lookup(DIRECTIONS, last)
        takes = after.isNotNull() & (((n >= 3) & (before.rlike(number) | is_suffix(before))) | ((n == 2) & _lookup(DIRECTIONS, first).isNull()))
        post = F.when((n >= 2) & takes, after)
        return F.struct(post.alias("post"), F.when(post.isNotNull(), F.slice(w, 1, n - 1)).otherwise(w).alias("w"))

    def with_pre(s: Column) -> Column:
        w, n = s["w"], F.size(s["w"])
        pre = F.when((n >= 2) & ~((n == 2) & is_suffix(F.get(w, F.lit(1)))), _lookup(DIRECTIONS, F.get(w, F.lit(0))))
        return F.struct(s["post"].alias("post"), pre.alias("pre"), F.when(pre.isNotNull(), F.slice(w, 2, n - 1)).otherwise(w).alias("w"))

    def finish(s: Column) -> Column:
        w, n = s["w"], F.size(s["w"])
        last = F.element_at(w, -1)
        numbered = (n >= 2) & last.rlike(number)
        modified = ~numbered & (n >= 3) & last.isin("EXTENSION", "EXT", "EXTN", "EXTNSN") & is_suffix(F.get(w, n - 2))
        rest = F.when(modified, F.slice(w, 1, n - 1)).otherwise(w)
        suffix = F.when(~numbered & (F.size(rest) >= 2), _lookup(table, F.element_at(rest, -1)))
        route = F.transform(w, lambda x: F.when(x.isin("RT", "RTE"), "ROUTE").when(x == "HWY", "HIGHWAY").otherwise(x))
        name = F.when(numbered, F.array_join(route, " ")).when(suffix.isNotNull(), F.array_join(F.slice(rest, 1, F.size(rest) - 1), " ")).otherwise(F.array_join(rest, " "))
        return F.struct(s["pre"].alias("predirectional"), name.alias("street_name"), suffix.alias("suffix"), s["post"].alias("postdirectional"), F.when(modified, "EXT").alias("post_modifier"))

    words = F.split(cleaned, " ")
    # Each step reads the one before through a one-element array, so that nothing is written out twice.
    step = lambda value, f: F.transform(F.array(value), f)[0]
    made = step(step(step(words, with_words), with_pre), finish)
    return F.when(cleaned != "", made)


def postal_unit(unit: Column) -> Column:
    """struct(designator, unit_number) of a secondary unit."""
    u = F.trim(F.regexp_replace(F.upper(F.coalesce(unit, F.lit(""))), "[.,]", ""))
    shape = r"^([A-Z]+)\s*#?\s*([A-Z0-9-]*)$"
    known = _lookup(UNITS, F.regexp_extract(u, shape, 1))
    number = F.when(known.isNotNull(), F.nullif(F.regexp_extract(u, shape, 2), F.lit(""))).otherwise(F.regexp_replace(u, r"^#\s*", ""))
    return F.when(u != "", F.struct(F.coalesce(known, F.lit("#")).alias("designator"), number.alias("unit_number")))
