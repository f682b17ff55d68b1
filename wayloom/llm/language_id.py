"""Language ID by hierarchical discrimination: the family first, then one-versus-one linear SVMs within it."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql import types as T

from wayloom.llm.shared import stored
from wayloom.llm.shingles import row_groups

UNKNOWN = "und"
PER_LANGUAGE = 400
BITS = 12
GRAMS = (1, 2, 3, 4)
ROUNDS = 30
STEP = 1 << 20
#: Families of language codes. A code that is not listed is a family of its own.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic", "is": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "pl": "slavic", "cs": "slavic", "sk": "slavic", "ru": "slavic", "uk": "slavic", "bg": "slavic",
    "fi": "uralic", "et": "uralic", "hu": "uralic",
}
# Bytes as features see them: other ASCII than letters is a gap.
_SEEN = np.arange(256, dtype=np.uint32)
_SEEN[:128] = 0x20
_SEEN[97:123] = np.arange(97, 123)
_SEEN[65:91] = np.arange(97, 123)


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def gram_slots(data: np.ndarray, bits: int = BITS, grams: tuple[int, ...] = GRAMS) -> Iterator[np.ndarray]:
    """For each gram length the hashed slot of the gram that ends at each byte; gaps are one space each."""
    seen = _SEEN[data]
    for n in grams:
        h = np.full(len(seen), n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for back in range(n):
            part = seen if not back else np.r_[np.full(min(back, len(seen)), 0x20, np.uint32), seen[:-back]][: len(seen)]
            h = (h ^ part) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
        yield h >> np.uint32(32 - bits)


def _shares(data: np.ndarray, bits: int = BITS) -> np.ndarray:
    counts = sum(np.bincount(slots, minlength=1 << bits) for slots in gram_slots(data, bits))
    return (counts / max(1, counts.sum())).astype(np.float32)


_SCALE = 100.0


def fit_svm(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, cost: float = 1.0) -> np.ndarray:
    """Weights and, last, the offset of a linear SVM (squared hinge loss), by dual coordinate descent; y is +1 or -1."""
    x = np.c_[x.astype(np.float64), np.ones(len(x))]
    alpha, w = np.zeros(len(x)), np.zeros(x.shape[1])
    diagonal = (x**2).sum(axis=1) + 0.5 / cost
    rng = np.random.default_rng(5)
    for _ in range(rounds):
        for i in rng.permutation(len(x)):
            gradient = y[i] * (x[i] @ w) - 1 + alpha[i] * 0.5 / cost
            new = max(alpha[i] - gradient / diagonal[i], 0.0)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


class Discriminator:
    """Families, and one SVM for each two families and each two languages of a family."""

    def __init__(self, x: np.ndarray, langs: list[str], bits: int = BITS, families: dict[str, str] = FAMILIES):
        self.bits = bits
        self.family = {lang: families.get(lang, lang) for lang in sorted(set(langs))}
        groups = sorted(set(self.family.values()))
        self.members = {g: [lang for lang, f in self.family.items() if f == g] for g in groups}
        self.pairs = [("family", a, b) for a, b in combinations(groups, 2)] + [("lang", a, b) for g in groups for a, b in combinations(self.members[g], 2)]
        own = {"lang": np.array(langs), "family": np.array([self.family[lang] for lang in langs])}
        fitted = []
        for kind, a, b in self.pairs:
            use = (own[kind] == a) | (own[kind] == b)
            fitted.append(fit_svm(x[use], np.where(own[kind][use] == a, 1.0, -1.0)))
        w = np.stack(fitted, axis=1) if fitted else np.zeros(((1 << bits) + 1, 0))
        self.weights, self.offsets = np.ascontiguousarray(w[:-1].T * _SCALE), w[-1]

    def margins(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Margin of each SVM for each text: the mean of its weights over the grams of the whole text."""
        sizes = np.diff(bounds)
        out = np.zeros((len(sizes), len(self.pairs)))
        if len(sizes) == 1:
            for at in range(int(bounds[0]), int(bounds[1]), STEP):
                before = max(int(bounds[0]), at - max(GRAMS))
                slots = [s[at - before :] for s in gram_slots(data[before : min(at + STEP, int(bounds[1]))], self.bits)]
                out[0] += [sum(w[s].sum() for s in slots) for w in self.weights]
        else:
            # Texts with a gap before each, so that no gram reaches into its neighbour.
            gap = max(GRAMS)
            starts = bounds[:-1] - bounds[0] + gap * np.arange(1, len(bounds))
            spread = np.full(int(sizes.sum()) + gap * len(sizes) + 1, 0x20, np.uint8)
            spread[np.arange(int(sizes.sum())) + np.repeat(gap * np.arange(1, len(bounds)), sizes)] = data[bounds[0] : bounds[-1]]
            slots = list(gram_slots(spread, self.bits))
            full = np.flatnonzero(sizes)
            cuts = np.stack([starts[full], starts[full] + sizes[full]], axis=1).ravel()
            for k, w in enumerate(self.weights):
                if len(full):
                    out[full, k] = np.add.reduceat(sum(w[s] for s in slots), cuts)[::2]
        return out / (np.maximum(sizes, 1)[:, None] * len(GRAMS)) + self.offsets

    def predict(self, margins: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The language of each row and a score from 0 to 1: how sure its closest decisions are."""
        langs, scores = [], np.ones(len(margins))
        at = {p: k for k, p in enumerate(self.pairs)}
        for i, row in enumerate(margins):
            family, s = _tournament("family", sorted(self.members), row, at)
            lang, t = _tournament("lang", self.members[family], row, at)
            langs.append(lang)
            scores[i] = s * t
        return langs, scores


def _tournament(kind: str, names: list[str], row: np.ndarray, at: dict) -> tuple[str, float]:
    """The name that wins most comparisons, ties by the sum of margins; with the chance of its weakest one."""
    votes = {n: [0, 0.0, 1.0] for n in names}
    for a, b in combinations(names, 2):
        m = float(row[at[kind, a, b]])
        for n, own in ((a, m), (b, -m)):
            v = votes[n]
            votes[n] = [v[0] + (own > 0), v[1] + own, min(v[2], 1 / (1 + np.exp(-2 * min(max(own, -20), 20))))]
    best = max(names, key=lambda n: votes[n][:2])
    return best, votes[best][2]


def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of hashed grams of each whole text, as shares."""
    for batch in batches:
        for lo, hi, data, bounds in row_groups(pc.utf8_lower(batch.column("text"))):
            rows = [_shares(data[a:b]).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("lang")[lo:hi], pa.array(rows, pa.binary())], ["lang", "shares"])


def fitted(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Discriminator | None:
    """A model of a bounded sample: at most `per_language` labelled texts of each language, in order of a hash of the text.

    Rows that are held out, have no language, or a text that is null or has no letter are not learnt from, and copies count
    once. Only text and lang are used, whole texts; the driver gets one vector of 4096 numbers for each sampled text.
    None if there is nothing to learn from.
    """
    usable = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    hashed = usable.withColumn("h", F.xxhash64("text"))
    # Hashes below a share of their range that leaves about eight times as many texts as wanted, and of these the smallest.
    names = stored(hashed.select("lang", "h"), "language-hashes")
    counts = names.groupBy("lang").agg(F.approx_count_distinct("h").alias("texts"))
    few = names.join(counts, "lang").filter(F.shiftrightunsigned("h", 11) * F.lit(2.0**-53) * F.col("texts") < 8 * per_language).select("lang", "h").distinct()
    drawn = few.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy(F.shiftrightunsigned("h", 1), "h"))).filter(F.col("n") <= per_language).select("lang", "h")
    # At most per_language rows of each language.
    sample = hashed.join(F.broadcast(drawn), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    got = sample.select("lang", "text").mapInArrow(features, "lang string, shares binary").collect()
    if not got:
        return None
    got.sort(key=lambda r: (r["lang"], bytes(r["shares"])))
    return Discriminator(np.stack([np.frombuffer(r["shares"], np.float32) for r in got]) * _SCALE, [r["lang"] for r in got])


def language_id(docs: DataFrame, columns: list[str] | None = None, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Every row of docs (doc_id, text, lang): row (a struct of `columns`, by default doc_id alone), held_out, lang_pred, score.

    lang_pred is a language of the learnt rows; `und` with score 0 where text is null or has no letter, or nothing can be
    learnt. Whole texts are read: the margin of an SVM is the mean of its weights over all hashed byte grams, case and
    signs aside. held_out marks the rows with crc32(doc_id as text) mod 4 = 2, which no model learns from; a null doc_id is not
    held out. A null lang is only not learnt from. Repeated rows each get their own, equal result.
    """
    handed = docs.sparkSession.sparkContext.broadcast(fitted(docs, per_language))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = handed.value
        for batch in batches:
            for lo, hi, data, bounds in row_groups(pc.utf8_lower(batch.column("text")), STEP):
                part = batch.slice(lo, hi - lo)
                lettered = part.column("lettered").to_numpy(zero_copy_only=False).astype(bool)
                langs, scores = ([UNKNOWN] * (hi - lo), np.zeros(hi - lo)) if own is None else own.predict(own.margins(data, bounds))
                langs = [x if ok else UNKNOWN for x, ok in zip(langs, lettered, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("held_out"), pa.array(langs, pa.string()), pa.array(np.where(lettered, scores, 0.0))], ["row", "held_out", "lang_pred", "score"]
                )

    carried = F.struct(*[F.col(f"`{c}`") for c in columns or ["doc_id"]]).alias("row")
    rows = docs.select(carried, held_out(F.col("doc_id")).alias("held_out"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([rows.schema["row"], T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(work, schema)


def drop_unknown(docs: DataFrame) -> DataFrame:
    """The documents with a language, with the columns of docs: `und` goes, whatever the score of the others."""
    return language_id(docs, docs.columns).filter(F.col("lang_pred") != UNKNOWN).select("row.*")
