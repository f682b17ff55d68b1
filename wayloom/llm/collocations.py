"""Collocations: frequent phrases grown pair by pair, counted in tiles of frequency-ranked ids.

Every level works on the same form: texts as sequences of ids, ranked by frequency within their language, with a gap where
something infrequent stood. Level one holds words; two neighbours at one level are a phrase one word longer, and the frequent
pairs, ranked anew, are the ids of the next. A ranking of at most SHIPPED entries, counted first, is sent to the tasks; of a
larger one each chunk of text gets what it holds by a join. Results are the same.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayloom.llm.bits import bit_filter, passes
from wayloom.llm.shared import stored
from wayloom.llm.shingles import U64, mixed
from wayloom.operators.chunks import value_chunks, with_position

LEAST = 100
WORDS = 5
PERCENT = 100
FIRST = 2000
CHUNK_BYTES = 1 << 19
SIDE_BITS = 9
DENSE = 1 << 15
BUFFERED = 1 << 20
SHIPPED = 1 << 19
HELD_WORDS = 1 << 18
_GAP = b"\xff"
#: What ends a piece of text.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes(0xFF if c in _ENDS else c + 32 if 65 <= c <= 90 else c for c in range(256))
_LOW = np.int64(0xFFFFFFFF)


def gapped(ids: np.ndarray) -> bytes:
    """Ids as bytes, each row of gaps (-1) drawn together to one."""
    gap = ids < 0
    again = gap.copy()
    again[1:] &= gap[:-1]
    again[:1] = False
    return ids[~again].astype("<i4").tobytes()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))


def token_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Lower-cased words of whole texts of one language, about CHUNK_BYTES of them at a time; _GAP stands between pieces."""
    for batch in batches:
        texts, langs, row = batch.column("text"), batch.column("lang").to_pylist(), 0
        while row < batch.num_rows:
            size, parts = 0, defaultdict(list)
            while row < batch.num_rows and size < CHUNK_BYTES:
                text = texts[row].as_buffer()
                if text is not None:
                    size += text.size
                    parts[langs[row]].append(text.to_pybytes())
                row += 1
            for lang, own in parts.items():
                yield lang, _GAP.join(own).translate(_TABLE).replace(_GAP, b" \xff ").split()


class Numbers(defaultdict):
    """Numbers words in the order they come; the gap has number 0."""

    def __init__(self):
        super().__init__()
        self.default_factory = self.__len__
        self[_GAP]

    def of(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.int32, len(tokens))

    def words(self) -> pa.Array:
        return pa.array([w.decode() for w in list(self)[1:]], pa.string())


class Known(dict):
    """Ids of words; -1 for any other and for the gap."""

    def __missing__(self, word: bytes) -> int:
        return -1


def counted_words(docs: DataFrame) -> DataFrame:
    """(lang, word, n) over whole texts; a task adds up until it holds HELD_WORDS different words."""

    def give(held: dict[str, tuple[Numbers, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for lang, (numbers, counts) in held.items():
            words = numbers.words()
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), len(words)), words, pa.array(counts[1 : len(numbers)])], ["lang", "word", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[Numbers, np.ndarray]] = {}
        for lang, tokens in token_groups(batches):
            numbers, counts = held.get(lang) or (Numbers(), np.zeros(0, np.int64))
            more = np.bincount(numbers.of(tokens), minlength=len(numbers))
            more[: len(counts)] += counts
            held[lang] = numbers, more
            if sum(len(n) for n, _ in held.values()) >= HELD_WORDS:
                yield from give(held)
                held = {}
        yield from give(held)

    return _texts(docs).mapInArrow(add, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def chunked(docs: DataFrame) -> DataFrame:
    """Whole texts in chunks of one language and about CHUNK_BYTES: the chunk's words, and the text as places in this list; -1
    stands between pieces. Rows (chunk, lang, words, ids)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, tokens in token_groups(batches):
            numbers = Numbers()
            ids = gapped(numbers.of(tokens) - 1)
            words = numbers.words()
            lists = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
            yield pa.RecordBatch.from_arrays([pa.array([lang]), lists, pa.array([ids], pa.binary())], ["lang", "words", "ids"])

    return _texts(docs).mapInArrow(cut, "lang string, words array<string>, ids binary").withColumn("chunk", F.expr("uuid()"))


def pair_codes(ids: np.ndarray) -> np.ndarray:
    """Of each place and the next one: both ids in one number, or -1 beside a gap."""
    a, b = ids[:-1].astype(np.int64), ids[1:].astype(np.int64)
    return np.where((a >= 0) & (b >= 0), a << 32 | b, np.int64(-1))


def tile_counts(codes: np.ndarray, side_bits: int = SIDE_BITS, dense: int = DENSE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pair codes and how often each comes.

    Ids ranked by frequency put the crowded pairs into the first tiles of 2^side_bits by 2^side_bits ids: a tile with `dense`
    entries is counted by direct address in an array of its cells; all others are sorted."""
    tiles, inverse, held = np.unique((codes >> (32 + side_bits)) << 32 | (codes & _LOW) >> side_bits, return_inverse=True, return_counts=True)
    crowded, mask = np.flatnonzero(held >= dense), np.int64((1 << side_bits) - 1)
    found, counts, rest = [], [], np.ones(len(codes), bool)
    for tile in crowded:
        own = inverse == tile
        rest &= ~own
        mine = codes[own]
        cells = np.bincount((mine >> 32 & mask) << side_bits | mine & mask, minlength=1 << 2 * side_bits)
        at = np.flatnonzero(cells)
        row, column = tiles[tile] >> 32, tiles[tile] & _LOW
        found.append((row << side_bits | at >> side_bits) << 32 | column << side_bits | at & mask)
        counts.append(cells[at])
    sparse, times = np.unique(codes[rest], return_counts=True)
    return np.concatenate([*found, sparse]), np.concatenate([*counts, times])


def _counted(lang: str, parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    codes, counts = tile_counts(np.concatenate(parts))
    step = 1 << 19
    for at in range(0, len(codes), step):
        part = codes[at : at + step]
        yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), len(part)), pa.array(part), pa.array(counts[at : at + step])], ["lang", "pair", "n"])


def counted_pairs(sequences: DataFrame) -> DataFrame:
    """(lang, pair, n): how often each two ids are neighbours. A task counts some million pairs of a language at a time."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = defaultdict(list)
        sizes: dict[str, int] = defaultdict(int)
        for batch in batches:
            for lang, ids in zip(batch.column("lang").to_pylist(), batch.column("ids"), strict=True):
                codes = pair_codes(np.frombuffer(ids.as_buffer(), "<i4"))
                codes = codes[codes >= 0]
                held[lang].append(codes)
                sizes[lang] += len(codes)
                while sizes and (sizes[lang] >= BUFFERED or sum(sizes.values()) >= 2 * BUFFERED):
                    most = max(sizes, key=sizes.get)
                    yield from _counted(most, held.pop(most))
                    sizes.pop(most)
                    if lang not in sizes:
                        break
        for lang, parts in held.items():
            yield from _counted(lang, parts)

    return sequences.select("lang", "ids").mapInArrow(count, "lang string, pair long, n long").groupBy("lang", "pair").agg(F.sum("n").alias("n"))


def ranked(counts: DataFrame, key: str) -> DataFrame:
    """Adds `id`: the place of each key within its language, from 0, by count, then by a hash of the key; ranges of counts and
    hashes are sorted apart, so that very many keys of one count do not meet in one task."""
    share = F.shiftrightunsigned(F.xxhash64(key), 12).cast("double") / F.lit(float(1 << 52))
    # Cut values are approximate and may differ from run to run: what they have dealt out is kept, so that all steps see the same.
    dealt = stored(value_chunks(stored(counts, "phrases-counted").withColumn("z", share - F.col("n")), ["lang"], "z"), "phrases-dealt")
    return with_position(dealt, ["lang"], ["z", key], F.col("_chunk")).withColumn("id", (F.col("pos") - 1).cast("int")).drop("z", "pos")


def by_language(frequent: DataFrame, key: str) -> dict[str, tuple[pa.Array, np.ndarray]] | None:
    """A ranking's keys and ids by language, if it has at most SHIPPED entries; it is counted before."""
    if frequent.count() > SHIPPED:
        return None
    table = frequent.select("lang", key, "id").sort("lang", key).toArrow().combine_chunks()
    langs, ends = table["lang"].to_pylist(), {}
    for i, lang in enumerate(langs):
        ends[lang] = ends.get(lang, (i,))[0], i + 1
    return {lang: (table[key].slice(lo, hi - lo).combine_chunks(), table["id"].slice(lo, hi - lo).to_numpy()) for lang, (lo, hi) in ends.items()}


def word_sequences(docs: DataFrame, frequent: DataFrame) -> DataFrame:
    """Texts as sequences (chunk, lang, ids) of the ranks of their frequent words, a gap for all else."""
    known = by_language(frequent, "word")
    if known is None:
        chunks = stored(chunked(docs), "phrases-chunks")
        held = chunks.select("chunk", "lang", F.posexplode("words").alias("at", "word"))
        return renamed_by_join(chunks, held.join(frequent, ["lang", "word"]), False)

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {lang: Known(zip((w.encode() for w in words.to_pylist()), ids.tolist(), strict=True)) for lang, (words, ids) in known.items()}
        for lang, tokens in token_groups(batches):
            if lang in tables:
                ids = np.fromiter(map(tables[lang].__getitem__, tokens), np.int32, len(tokens))
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([gapped(ids)], pa.binary())], ["lang", "ids"])

    return _texts(docs).mapInArrow(rename, "lang string, ids binary").select(F.expr("uuid()").alias("chunk"), "lang", "ids")


def pair_sequences(sequences: DataFrame, frequent: DataFrame) -> DataFrame:
    """Sequences (chunk, lang, ids) in the ids of frequent pairs of neighbours; a pair that is not frequent becomes a gap."""
    known = by_language(frequent, "pair")
    if known is None:
        held = held_pairs(sequences, frequent).join(frequent, ["lang", "pair"]).withColumn("at", F.col("pair"))
        return renamed_by_join(sequences, held, True)

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                pairs, ids = known.get(batch.column("lang")[row].as_py(), (None, None))
                if pairs is not None:
                    own = gapped(_found(_codes(batch.column("ids")[row], True), pairs.to_numpy(), ids))
                    yield pa.RecordBatch.from_arrays([batch.column("chunk")[row : row + 1], batch.column("lang")[row : row + 1], pa.array([own], pa.binary())], ["chunk", "lang", "ids"])

    return sequences.select("chunk", "lang", "ids").mapInArrow(rename, "chunk string, lang string, ids binary")


def renamed_by_join(sequences: DataFrame, held: DataFrame, pairs: bool) -> DataFrame:
    """Sequences in new ids by a table of what each chunk holds (chunk, at, id): of its pairs, or of places in its words."""
    lookup = held.groupBy("chunk").agg(F.collect_list(F.struct(F.col("at").cast("long").alias("at"), "id")).alias("entries"))

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ids, entries in zip(batch.column("ids"), batch.column("entries"), strict=True):
                known, new = (entries.values.field(k).to_numpy() for k in (0, 1))
                order = np.argsort(known)
                out.append(gapped(_found(_codes(ids, pairs), known[order], new[order])))
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), batch.column("lang"), pa.array(out, pa.binary())], ["chunk", "lang", "ids"])

    return sequences.select("chunk", "lang", "ids").join(lookup, "chunk").mapInArrow(rename, "chunk string, lang string, ids binary")


def _codes(ids: pa.Scalar, pairs: bool) -> np.ndarray:
    own = np.frombuffer(ids.as_buffer(), "<i4")
    return pair_codes(own) if pairs else own.astype(np.int64)


def _found(codes: np.ndarray, known: np.ndarray, new: np.ndarray) -> np.ndarray:
    """The new ids of codes by a sorted list of known ones; -1 for the others."""
    at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
    return np.where(known[at] == codes, new[at], -1)


def held_pairs(sequences: DataFrame, frequent: DataFrame) -> DataFrame:
    """(chunk, lang, pair): the distinct pairs of each chunk that may be frequent, by a bit filter of fixed size."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(mixed(batch.column(0).to_numpy().view(U64)).view(np.int64))], ["hash"])

    bits = bit_filter(frequent.select("pair").mapInArrow(spread, "hash long"), "hash")

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = []
            for ids in batch.column("ids"):
                codes = pair_codes(np.frombuffer(ids.as_buffer(), "<i4"))
                codes = np.unique(codes[codes >= 0])
                own.append(codes[passes(bits, mixed(codes.view(U64)))])
            ends = np.cumsum([0, *map(len, own)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(own)))
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), batch.column("lang"), lists], ["chunk", "lang", "pairs"])

    return sequences.mapInArrow(hold, "chunk string, lang string, pairs array<long>").select("chunk", "lang", F.explode("pairs").alias("pair"))


def frequent_phrases(docs: DataFrame, least: int = LEAST, words: int = WORDS) -> tuple[list[DataFrame], DataFrame]:
    """Phrases of one to `words` words that come at least `least` times in their language, a table for each length, and the
    number of all words of each language.

    A table has lang, id, phrase, last (word), n, first_counts and last_counts (how often its first k and its last k words
    come, for k from 1), and from two words on a and b, the ids of what it is without its last and its first word. A phrase
    cannot come more often than its parts, so only frequent neighbours are counted, and counts are exact.
    """
    counts = stored(counted_words(docs), "phrases-counts")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    frequent = stored(ranked(counts.filter(F.col("n") >= least), "word"), "phrases-words")
    own = F.array("n")
    levels = [frequent.select("lang", "id", F.col("word").alias("phrase"), F.col("word").alias("last"), "n", own.alias("first_counts"), own.alias("last_counts"))]
    sequences = stored(word_sequences(docs, frequent), "phrases-ids")
    for length in range(2, words + 1):
        frequent = stored(ranked(counted_pairs(sequences).filter(F.col("n") >= least), "pair"), "phrases-pairs")
        levels.append(stored(_grown(levels[-1], frequent), "phrases-level"))
        if length < words:
            sequences = stored(pair_sequences(sequences, frequent), "phrases-ids")
    return levels, totals


def _grown(below: DataFrame, frequent: DataFrame) -> DataFrame:
    pairs = frequent.select("lang", "id", "n", F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).cast("int").alias("b"))
    left = below.select("lang", F.col("id").alias("a"), F.col("phrase").alias("start"), "first_counts")
    right = below.select("lang", F.col("id").alias("b"), "last", "last_counts")
    both = pairs.join(left, ["lang", "a"]).join(right, ["lang", "b"])
    return both.select(
        "lang", "id", F.concat_ws(" ", "start", "last").alias("phrase"), "last", "n",
        F.concat("first_counts", F.array("n")).alias("first_counts"), F.concat("last_counts", F.array("n")).alias("last_counts"), "a", "b",
    )


def _wide(c: str) -> str:
    return f"cast({c} as decimal(19, 0))"


def lowest_cut(length: int) -> Column:
    """The cut of a phrase of `length` words with the lowest score, then after the fewest words, as (score, k, l, r)."""
    cuts = [
        F.struct(
            F.expr(f"(1000 * {_wide('n')} * {_wide('total')}) div ({_wide(f'first_counts[{k - 1}]')} * {_wide(f'last_counts[{length - k - 1}]')})").alias("score"),
            F.lit(k).alias("k"), F.col("first_counts")[k - 1].alias("l"), F.col("last_counts")[length - k - 1].alias("r"),
        )
        for k in range(1, length)
    ]
    return F.array_min(F.array(*cuts))


def collocations(docs: DataFrame, least: int = LEAST, words: int = WORDS, percent: int = PERCENT, first: int | None = FIRST) -> DataFrame:
    """Collocations of docs (text, lang): lang, rank, phrase, a, l, r, n, score, the `first` of each language (None: all).

    Texts are lower-cased (A-Z only) and cut at `[.,;:!?\\x0A-\\x0D]` into pieces, these into words `[^\\x20\\x09]+`. Per
    language, n counts all words, and candidates are phrases of 2 to `words` words inside pieces with a >= `least`
    occurrences, overlapping ones included. A cut gives l and r, the counts of the two parts, and the score
    floor(1000 * a * n / (l * r)); the lowest-scoring cut counts, of equal ones the first. A candidate goes when a longer one
    that holds it comes at least `percent` % as often: whatever lies between the two comes as often, so one word more is
    looked at. Order: score and a from the largest, then the phrase by bytes.

    Null texts are empty, a null language counts as `und`; rows are not told apart, so repeated texts count again. Texts without
    words add nothing; no rows give no rows. A text longer than a chunk makes a chunk of its own size.
    """
    levels, totals = frequent_phrases(docs, least, words)
    parts = []
    for length, level in enumerate(levels[1:], 2):
        if length < words:
            longer = levels[length].select("lang", F.explode(F.array("a", "b")).alias("id"), "n").groupBy("lang", "id").agg(F.max("n").alias("longer"))
            level = level.join(longer, ["lang", "id"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("n")))
        parts.append(level.join(totals, "lang").select("lang", "phrase", F.col("n").alias("a"), F.col("total").alias("n"), lowest_cut(length).alias("cut")))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    found = found.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    placed = found.withColumn("rank", F.row_number().over(order))
    placed = placed if first is None else placed.filter(F.col("rank") <= first)
    return placed.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), listed AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces
), starts AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM listed WHERE len(w) > 0
), spans AS (
  SELECT lang, array_to_string(w[i : i + k - 1], ' ') AS phrase, k FROM starts, range(1, 6) AS ks(k) WHERE i + k - 1 <= len(w)
), f AS (
  SELECT lang, phrase, k, count(*) AS n FROM spans GROUP BY lang, phrase, k HAVING count(*) >= 100
), totals AS (
  SELECT lang, count(*) AS n FROM starts GROUP BY lang
), candidates AS (
  SELECT lang, phrase, k, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1
), whole AS (
  SELECT c.lang, c.phrase, max(x.a) AS longer FROM candidates c JOIN candidates x ON x.lang = c.lang AND x.k > c.k AND contains(' ' || x.phrase || ' ', ' ' || c.phrase || ' ') GROUP BY c.lang, c.phrase
), cuts AS (
  SELECT c.lang, c.phrase, c.a, c.k, t.n, cut, array_to_string(c.w[1 : cut], ' ') AS head, array_to_string(c.w[cut + 1 : c.k], ' ') AS tail
  FROM candidates c JOIN totals t USING (lang), range(1, 5) AS ks(cut) WHERE cut < c.k
), scored AS (
  SELECT c.lang, c.phrase, c.a, h.n AS l, r.n AS r, c.n, cut, (1000 * c.a::HUGEINT * c.n::HUGEINT) // (h.n::HUGEINT * r.n::HUGEINT) AS score
  FROM cuts c JOIN f h ON h.lang = c.lang AND h.phrase = c.head JOIN f r ON r.lang = c.lang AND r.phrase = c.tail
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), placed AS (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, encode(b.phrase)) AS rank, b.phrase, b.a, b.l, b.r, b.n, b.score::BIGINT AS score
  FROM best b LEFT JOIN whole w USING (lang, phrase) WHERE w.longer IS NULL OR 100 * w.longer < 100 * b.a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM placed WHERE rank <= 2000
"""
