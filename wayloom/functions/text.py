"""Text normalisers, keyword rules, name similarity and character n-grams."""

from __future__ import annotations

import difflib
import re
import unicodedata
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from wayloom.functions.taxonomy import OUT_OF_SCOPE, SECTOR_NAMES

# Latin letters with marks and their plain form.
ACCENTED = "áàâäãåāéèêëēíìîïīóòôöõōúùûüūñçýÿ"
PLAIN = "aaaaaaaeeeeeiiiiioooooouuuuuncyy"

# Ratios of names that a task keeps at once.
RATIOS_KEPT = 1 << 16
# Words whose n-grams a task keeps.
WORDS_KEPT = 1 << 17


def plain_latin(text: Column) -> Column:
    """Lower case without accents, for Latin letters; stays inside generated code."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


@F.pandas_udf(StringType())
def ascii_folded(text: pd.Series) -> pd.Series:
    """Lower case, compatibility-decomposed, everything outside ASCII dropped."""
    return text.str.lower().str.normalize("NFKD").str.encode("ascii", "ignore").str.decode("ascii")


@F.pandas_udf(StringType())
def unmarked(text: pd.Series) -> pd.Series:
    """Lower case, compatibility-decomposed, combining marks dropped, other scripts kept."""
    decomposed = text.str.lower().str.normalize("NFKD")
    return decomposed.map(lambda s: "".join(c for c in s if not unicodedata.combining(c)), na_action="ignore")


def business_text(text: Column) -> Column:
    """ASCII letters, digits and single spaces only."""
    return F.trim(F.regexp_replace(F.regexp_replace(ascii_folded(text), r"[^a-z0-9\s]+", " "), r"\s+", " "))


def place_name(name: Column) -> Column:
    """Name without case, marks and punctuation, spaces collapsed; NULL gives ''."""
    clean = F.regexp_replace(unmarked(name), r"\p{P}", "")
    return F.coalesce(F.trim(F.regexp_replace(clean, r"(?U)\s+", " ")), F.lit(""))


def match_name(name: Column) -> Column:
    """Normaliser for matching two sources: ASCII, other signs to spaces, '' for unnamed listings."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(ascii_folded(name), r"[^a-z0-9 ]+", " "), r"\s+", " "))
    return F.when(clean.isNull() | F.lower(name).contains("sin nombre"), "").otherwise(clean)


def model_text(text: Column) -> Column:
    """Normaliser of the text model: lower case without accents, ñ as n; letters of any block are decomposed."""
    return unmarked(text)


def is_unnamed(normalised: Column) -> Column:
    return (normalised == "sin nombre") | normalised.endswith(" sin nombre")


def useful_street_name(name: Column) -> Column:
    """At least three characters and three letters."""
    return F.coalesce((F.length(name) >= 3) & (F.regexp_count(name, F.lit(r"\p{L}")) >= 3), F.lit(False))


def preferred_name(tags: Column) -> Column:
    """English name when there is one, else the local name, else ''."""
    english = F.nullif(F.try_element_at(tags, F.lit("name:en")), F.lit(""))
    return F.trim(F.coalesce(english, F.try_element_at(tags, F.lit("name")), F.lit("")))


# --- keyword rules ---------------------------------------------------------------------------------------------------
def word_pattern(keyword: str) -> str:
    """Whole words of a keyword, each allowed its Spanish plural."""
    return r"\b" + r"(?:e?s)?\s+".join(re.escape(w) for w in keyword.split()) + r"(?:e?s)?\b"


def _any_of(words: Sequence[str]) -> str:
    return "|".join(word_pattern(w) for w in words)


def first_position(text: Column, pattern: str) -> Column:
    """0-based position of the first match, NULL without one."""
    return F.nullif(F.regexp_instr(text, F.lit(f"({pattern})")), F.lit(0)) - 1


def keyword_category(text: Column, rules: Mapping[str, Sequence[str]]) -> tuple[Column, Column]:
    """Category by registry order, and the position of the earliest hit of ANY category. `text` is normalised."""
    spots = {category: first_position(text, _any_of(words)) for category, words in rules.items()}
    category = F.coalesce(*[F.when(spot.isNotNull(), F.lit(c)) for c, spot in spots.items()])
    return category, F.array_min(F.array(*spots.values()))


def out_of_scope(text: Column, rules: Mapping[str, tuple[str, Sequence[str]]] = OUT_OF_SCOPE) -> Column:
    """(position, -length, rank, activity) of the earliest hit, the longest at equal position; NULL without one.

    Longer keywords come first in each pattern, so at one position the longest of an activity matches."""
    hits = []
    for order, (activity, (_, words)) in enumerate(rules.items()):
        pattern = _any_of(sorted(words, key=len, reverse=True))
        spot = first_position(text, pattern)
        length = F.length(F.regexp_extract(text, f"({pattern})", 1))
        found = F.struct(
            spot.alias("position"), (-length).alias("minus_length"), F.lit(order).alias("rank"), F.lit(activity).alias("activity")
        )
        hits.append(F.when(spot.isNotNull(), found))
    return F.array_min(F.filter(F.array(*hits), lambda h: h.isNotNull()))


def interpret(
    df: DataFrame, text: str, rules: Mapping[str, Sequence[str]], model_category: str | None = None,
    outside: Mapping[str, tuple[str, Sequence[str]]] = OUT_OF_SCOPE,
) -> DataFrame:
    """Adds category, activity and source for a normalised text: keywords first, an activity out of scope when it is
    named before any business, and the answer of a trained model only where neither speaks."""
    category, spot = keyword_category(F.col(text), rules)
    read = df.withColumns({"_keyword": category, "_spot": spot, "_outside": out_of_scope(F.col(text), outside)})
    earlier = F.col("_spot").isNull() | (F.col("_outside.position") < F.col("_spot"))
    read = read.withColumn("_refused", F.col("_outside").isNotNull() & earlier)
    learned = F.col(model_category) if model_category is not None else F.lit(None).cast("string")
    return read.withColumns(
        {
            "category": F.when(~F.col("_refused"), F.coalesce("_keyword", learned)),
            "activity": F.when(F.col("_refused"), F.col("_outside.activity")),
            "source": F.when(F.col("_refused"), "fuera_de_alcance")
            .when(F.col("_keyword").isNotNull(), "palabras_clave")
            .when(learned.isNotNull(), "modelo"),
        }
    ).drop("_keyword", "_spot", "_outside", "_refused")


def sector(category: Column, activity: Column) -> Column:
    """Economic sector: that of the activity, or the tertiary one for every category that can be analysed."""
    table = F.create_map(*[F.lit(x) for a, (s, _) in OUT_OF_SCOPE.items() for x in (a, s)])
    return F.coalesce(F.try_element_at(table, activity), F.when(category.isNotNull(), "terciario"))


def sector_name(sector_key: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in SECTOR_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, sector_key), F.lit(""))


# --- similarity and n-grams ------------------------------------------------------------------------------------------
def name_tokens(normalised: Column, stop: Sequence[str] = ()) -> Column:
    words = F.filter(F.split(normalised, " "), lambda w: F.length(w) >= 3)
    return F.array_except(words, F.array(*[F.lit(s) for s in stop]).cast("array<string>"))


def counted_characters(text: Column) -> Column:
    """Every character with its number among the equal ones of the text, as one number: texts hold in common what these arrays do."""

    def numbered(c: Column) -> Column:
        copies = F.length(text) - F.length(F.replace(text, c, F.lit("")))
        return F.transform(F.sequence(F.lit(1), copies), lambda k: F.ascii(c).cast("long") * (1 << 32) + k)

    return F.flatten(F.transform(F.filter(F.array_distinct(F.split(text, "")), lambda c: c != ""), numbered))


def common_characters(a: Column, b: Column) -> Column:
    """Number of characters that both texts hold, a character as often as in the text that has fewer of it."""
    return F.size(F.array_intersect(counted_characters(a), counted_characters(b)))


@F.pandas_udf(DoubleType())
def sequence_ratio(names: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Share of matching stretches. A task keeps the ratios of its last pairs: names meet again where places lie close."""
    known = {}
    for a, b in names:
        ratios = []
        for pair in zip(a, b, strict=True):
            if pair not in known:
                if len(known) >= RATIOS_KEPT:
                    known.clear()
                known[pair] = difflib.SequenceMatcher(None, *pair).ratio()
            ratios.append(known[pair])
        yield pd.Series(ratios, dtype="float64")


# A filter on the ratio would otherwise be moved below it and work it out a second time.
sequence_ratio = sequence_ratio.asNondeterministic()


def name_similarity(a: Column, b: Column, stop: Sequence[str] = ()) -> Column:
    """0 for a missing name, 1 for equal ones, otherwise the sequence ratio, at least 0.9 when one token set holds the other."""
    ta, tb = name_tokens(a, stop), name_tokens(b, stop)
    nested = (F.size(ta) > 0) & (F.size(tb) > 0) & (
        (F.size(F.array_except(ta, tb)) == 0) | (F.size(F.array_except(tb, ta)) == 0)
    )
    ratio = sequence_ratio(a, b)
    return (
        F.when((a == "") | (b == ""), 0.0)
        .when(a == b, 1.0)
        .otherwise(F.greatest(ratio, F.when(nested, 0.9).otherwise(0.0)))
    )


def word_ngrams(text: Column, low: int = 2, high: int = 5) -> Column:
    """Character n-grams inside space-padded words. A padded word no longer than n yields itself once, and then no
    longer n is tried for it."""
    words = F.filter(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), lambda w: w != "")

    def grams(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        size = F.length(padded)
        sizes = F.filter(F.sequence(F.lit(low), F.lit(high)), lambda n: (n == low) | (size > n - 1))

        def of_size(n: Column) -> Column:
            starts = F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1)))
            return F.transform(starts, lambda i: F.substr(padded, i, n))

        return F.flatten(F.transform(sizes, of_size))

    return F.flatten(F.transform(words, grams))


def _hashed(bytes_: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Murmur3 (x86, 32 bits, seed 42) of pieces of a byte string, as HashingTF takes it of the piece as a string; signed."""
    out = np.zeros(len(starts), np.uint32)

    def mixed(k: np.ndarray) -> np.ndarray:
        k = k * np.uint32(0xCC9E2D51)
        return ((k << np.uint32(15)) | (k >> np.uint32(17))) * np.uint32(0x1B873593)

    for size in np.unique(lengths):
        own = np.flatnonzero(lengths == size)
        piece = bytes_[starts[own, None] + np.arange(size)].astype(np.uint32)
        h = np.full(len(own), 42, np.uint32)
        for at in range(0, size - size % 4, 4):
            h = h ^ mixed(sum(piece[:, at + i] << np.uint32(8 * i) for i in range(4)))
            h = ((h << np.uint32(13)) | (h >> np.uint32(19))) * np.uint32(5) + np.uint32(0xE6546B64)
        if size % 4:
            h = h ^ mixed(sum(piece[:, size - size % 4 + i] << np.uint32(8 * i) for i in range(size % 4)))
        h = h ^ np.uint32(size)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        out[own] = h ^ (h >> np.uint32(16))
    return out.view(np.int32)


def gram_places(words: Sequence[str], low: int, high: int, slots: int) -> list[np.ndarray]:
    """The places of the n-grams of each word, those of `word_ngrams` hashed as HashingTF hashes them, many words at a time."""
    padded = [f" {w} " for w in words]
    whole = np.frombuffer("".join(padded).encode(), np.uint8)
    at = np.r_[np.flatnonzero((whole & 0xC0) != 0x80), len(whole)]  # where characters start
    sizes = np.array([len(w) for w in padded])
    first = np.cumsum(sizes) - sizes
    owners, begins, ends = [], [], []
    for n in range(low, high + 1):
        long = np.flatnonzero((sizes >= n) | (n == low))
        count = np.maximum(sizes[long] - n + 1, 1)
        owner = np.repeat(long, count)
        begin = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + first[owner]
        owners.append(owner)
        begins.append(begin)
        ends.append(np.minimum(begin + n, first[owner] + sizes[owner]))
    owner, begin, end = (np.concatenate(x) for x in (owners, begins, ends))
    places = _hashed(whole, at[begin], at[end] - at[begin]) % slots
    order = np.argsort(owner, kind="stable")
    return np.split(places[order].astype(np.int32), np.cumsum(np.bincount(owner, minlength=len(words)))[:-1])
