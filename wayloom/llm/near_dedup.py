"""MinHash near-dedup by an inverted join on signature coordinates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.llm.shared import components, stored
from wayloom.llm.shingles import U64, WIDTH, row_groups, shingle_hashes

COORDINATES = 32
THRESHOLD = 11
PERCENT = 75
BLOCK = 1024
FINE = 512
FINE_LEAST = 333
_STEP = 1 << 15
_CANDIDATE = "a long, b long, place int, value int, x int, y int"
_SKETCH = "doc_id long, n_shingles long, set_a long, set_b long, sig array<int>"


def _coefficients(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(77)
    return rng.integers(1, 2**63, k, U64) | U64(1), rng.integers(1, 2**63, k, U64)


def signature(values: np.ndarray, times: np.ndarray, plus: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over a set; a very large set is taken in steps."""
    best = np.full(len(times), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(values), _STEP):
        part = values[at : at + _STEP, None] * times + plus
        best = np.minimum(best, (part >> U64(32)).astype(np.uint32).min(axis=0))
    return best.view(np.int32)


def sketches(docs: DataFrame, coordinates: int = COORDINATES, width: int = WIDTH) -> DataFrame:
    """Of each document: the size of its shingle set, 128 bits that name the set, and its MinHash signature."""
    times, plus = _coefficients(coordinates)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, bounds in row_groups(batch.column("text")):
                hashes, runs = shingle_hashes(data, bounds, width)
                ends = np.cumsum(runs)
                sizes, names, sigs = np.zeros(hi - lo, np.int64), np.zeros((hi - lo, 2), np.int64), []
                for i in range(hi - lo):
                    own = np.unique(hashes[ends[i] - runs[i] : ends[i]])
                    sizes[i] = len(own)
                    names[i] = own.sum(dtype=U64).astype(np.int64), np.bitwise_xor.reduce(own * U64(0x9E3779B97F4A7C15) ^ (own >> U64(29))).astype(np.int64) if len(own) else 0
                    sigs.append(signature(own, times, plus) if len(own) else np.zeros(0, np.int32))
                lengths = np.cumsum([0] + [len(s) for s in sigs]).astype(np.int32)
                sig = pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate(sigs) if sigs else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[lo:hi], pa.array(sizes), pa.array(names[:, 0]), pa.array(names[:, 1]), sig],
                    ["doc_id", "n_shingles", "set_a", "set_b", "sig"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(sketch, _SKETCH)


def fine_sketch(values: np.ndarray, times: np.ndarray, plus: np.ndarray) -> bytes:
    """One byte of each of many more MinHash values: enough to tell most pairs below the wanted similarity from those above."""
    low = (values >> U64(32)).astype(np.uint32)
    best = np.full(len(times), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(low), 2048):
        best = np.minimum(best, (low[at : at + 2048, None] * times + plus).min(axis=0))
    return ((best * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()


def shingle_sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The distinct shingle hashes of each document and its fine sketch: (doc_id, shingles, fine)."""
    rng = np.random.default_rng(78)
    times, plus = rng.integers(1, 2**32, FINE, np.uint32) | np.uint32(1), rng.integers(1, 2**32, FINE, np.uint32)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, bounds in row_groups(batch.column("text")):
                hashes, runs = shingle_hashes(data, bounds, width)
                ends = np.cumsum(runs)
                own = [np.unique(hashes[e - r : e]) for e, r in zip(ends, runs, strict=True)]
                lengths = np.cumsum([0] + [len(s) for s in own]).astype(np.int32)
                values = np.concatenate(own) if own else np.zeros(0, U64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[lo:hi], pa.ListArray.from_arrays(pa.array(lengths), pa.array(values.view(np.int64))), pa.array([fine_sketch(s, times, plus) for s in own], pa.binary())],
                    ["doc_id", "shingles", "fine"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(sets, "doc_id long, shingles array<long>, fine binary")


def postings(sets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Documents posted under (place, value) of their signature, prefixes only: (place, value, doc_id, sig, posted, weight).

    `posted` has a bit for each place under which the document is posted, `weight` is how many documents share its entries.

    A pair that agrees in `threshold` coordinates has one of them outside the `threshold` - 1 most frequent entries of
    either side, in one order of all entries by frequency. So entries that no other document has are left out, the
    `threshold` - 1 most frequent ones are skipped, and documents with fewer shared entries have no partner at all.
    """
    entries = sets.select("doc_id", F.posexplode("sig").alias("place", "value"))
    shared = entries.groupBy("place", "value").agg(F.count("*").alias("n")).filter("n > 1")
    prefix = (
        entries.join(shared, ["place", "value"])
        .groupBy("doc_id")
        .agg(F.sort_array(F.collect_list(F.struct("n", "place", "value"))).alias("e"))
        .filter(F.size("e") >= threshold)
        .select("doc_id", F.expr("aggregate(e, 0L, (s, x) -> s + x.n)").alias("weight"), F.expr(f"slice(e, 1, size(e) - {threshold - 1})").alias("e"))
        .select("doc_id", "weight", F.expr("aggregate(e, 0L, (m, x) -> m | shiftleft(1L, x.place))").alias("posted"), F.explode("e").alias("e"))
    )
    return prefix.select("e.place", "e.value", "doc_id", "posted", "weight").join(sets.select("doc_id", "sig"), "doc_id")


def _agreeing(a: str, b: str) -> str:
    return f"aggregate(zip_with({a}, {b}, (x, y) -> if(x = y, 1, 0)), 0, (s, x) -> s + x)"


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose whole sets have 100 * intersection >= percent * union."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").filter(F.size("sa") > 0).join(right, "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    return both.filter(F.expr(f"100L * common >= {percent}L * (size(sa) + size(sb) - common)")).select("a", "b")


def hub_pairs(posts: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Each posted document with the hub of one of its posting lists, the document whose entries most others share.

    In a group of copies with changes that is the one with the fewest changes, close to most of the others."""
    hubs = posts.groupBy("place", "value").agg(F.max(F.struct("weight", "doc_id", "sig")).alias("hub"))
    return (
        posts.join(hubs, ["place", "value"])
        .filter("doc_id <> hub.doc_id")
        .filter(F.expr(f"{_agreeing('sig', 'hub.sig')} >= {threshold}"))
        .groupBy(F.col("doc_id").alias("b")).agg(F.max(F.struct("hub.weight", "hub.doc_id")).alias("h")).select(F.col("h.doc_id").alias("a"), "b")
    )


def rest_pairs(posts: DataFrame, roots: DataFrame, full: DataFrame, threshold: int = THRESHOLD, block: int = BLOCK, folded: bool = False) -> DataFrame:
    """All pairs (a, b) that meet in a posting list, agree in `threshold` coordinates and are in different components so far,
    with the block (place, value, x, y) that has found them. `folded` gives a block with more pairs than documents as its
    documents instead (a, with b null), so that a block never gives more rows than it has.

    Lists within one component are left out before. Of the others, every document meets those outside the list's largest
    component, block against block of about `block` documents, each two blocks in a group of their own. A pair comes from the
    first list that both are posted in, and only if its fine sketches agree in FINE_LEAST places; a pair at similarity 0.75
    agrees in fewer with a probability below one in a million.
    """
    posts = posts.join(roots.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    parts = posts.groupBy("place", "value", "root").agg(F.count("*").alias("n"))
    lists = parts.groupBy("place", "value").agg(F.max(F.struct("n", "root")).alias("main"), F.sum("n").alias("n"), F.count("*").alias("roots")).filter("roots > 1")
    blocks = lists.select(
        "place", "value", F.col("main.root").alias("main"), F.ceil(F.col("n") / block).cast("int").alias("xs"), F.ceil((F.col("n") - F.col("main.n")) / block).cast("int").alias("ys")
    )
    cut = posts.join(blocks, ["place", "value"]).join(full.select("doc_id", "fine"), "doc_id")
    hashed = F.xxhash64("doc_id")
    left = cut.select(
        "place", "value", F.pmod(hashed, "xs").cast("int").alias("x"), F.explode(F.expr("sequence(0, ys - 1)")).alias("y"), F.lit(0).alias("side"), (F.col("root") == F.col("main")).alias("mains"), "doc_id", "root", "sig", "posted", "fine"
    )
    right = cut.filter("root <> main").select(
        "place", "value", F.explode(F.expr("sequence(0, xs - 1)")).alias("x"), F.pmod(hashed, "ys").cast("int").alias("y"), F.lit(1).alias("side"), F.lit(False).alias("mains"), "doc_id", "root", "sig", "posted", "fine"
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)])
            starts = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)])
            for s, e in zip(starts, np.r_[starts[1:], batch.num_rows], strict=True):
                key = tuple(keys[:, s])
                if key != last and held:
                    yield _meet(held, threshold, folded)
                    held = []
                last = key
                held.append(batch.slice(s, e - s))
        if held:
            yield _meet(held, threshold, folded)

    keyed = left.unionByName(right).repartition("place", "value", "x", "y").sortWithinPartitions("place", "value", "x", "y")
    return keyed.mapInArrow(compare, _CANDIDATE)


def _meet(held: list[pa.RecordBatch], threshold: int, folded: bool) -> pa.RecordBatch:
    """Candidates of one group: pairs of its left rows with its right rows, a pair whose rows both come on either side only
    once; or, folded, if they are more than its documents, the documents that stand in them."""
    rows = pa.Table.from_batches(held)
    side, mains, ids, roots, posted = (rows[c].to_numpy() for c in ("side", "mains", "doc_id", "root", "posted"))
    sig = rows["sig"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
    fine = np.frombuffer(b"".join(rows["fine"].to_pylist()), np.uint8).reshape(len(ids), -1)
    before = (1 << int(rows["place"][0].as_py())) - 1
    bits = np.int64(1) << np.arange(sig.shape[1], dtype=np.int64)
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    step = max(1, 4096 // max(1, len(right)))
    found, count, taking, most = [], 0, np.zeros(len(ids), bool), len(np.unique(ids)) if folded else np.inf
    for at in range(0, len(left), step):
        own = left[at : at + step]
        i, j = np.nonzero((roots[own, None] != roots[right]) & (mains[own, None] | (ids[own, None] < ids[right])))
        i, j = own[i], right[j]
        same = sig[i] == sig[j]
        good = (same.sum(axis=1) >= threshold) & ((same @ bits) & posted[i] & posted[j] & before == 0)
        i, j = i[good], j[good]
        good = (fine[i] == fine[j]).sum(axis=1) >= FINE_LEAST
        i, j = i[good], j[good]
        count += len(i)
        taking[i] = taking[j] = True
        if count <= most:
            found.append((ids[i], ids[j]))
    if count <= most:
        a, b = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(2))
        a, b = pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))
    else:
        a = pa.array(np.unique(ids[taking]))
        b = pa.nulls(len(a), pa.int64())
    key = [pa.repeat(pa.scalar(rows[c][0].as_py(), pa.int32()), len(a)) for c in ("place", "value", "x", "y")]
    return pa.RecordBatch.from_arrays([a, b, *key], ["a", "b", "place", "value", "x", "y"])


def block_links(crowded: DataFrame, full: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) that connect, within each block of documents (doc_id, place, value, x, y), all that links on whole sets
    connect: at most one less than it has documents. A document outside the largest part so far is compared with the whole
    block at once, by a count of marked shingles; when only the largest part is left, all links between parts are known."""

    def connect(rows: pa.Table) -> pa.Table:
        ids, lists = rows["doc_id"].to_numpy(), rows["shingles"].combine_chunks()
        sizes, n = lists.value_lengths().to_numpy(), rows.num_rows
        distinct, codes = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        owner, ends = np.repeat(np.arange(n), sizes), np.cumsum(sizes)
        part, tried, marked, links = np.arange(n), np.zeros(n, bool), np.zeros(len(distinct), bool), []
        while True:
            todo = np.flatnonzero(~tried & (part != np.bincount(part, minlength=n).argmax()))
            if not len(todo):
                break
            i = int(todo[0])
            tried[i] = True
            own = codes[ends[i] - sizes[i] : ends[i]]
            marked[own] = True
            common = np.bincount(owner, marked[codes], n).astype(np.int64)
            marked[own] = False
            near = np.flatnonzero((100 * common >= percent * (sizes + sizes[i] - common)) & (part != part[i]) & (sizes > 0))
            parts, first = np.unique(part[near], return_index=True)
            links += [(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in near[first]]
            part[np.isin(part, parts)] = part[i]
        return pa.table({"a": pa.array([int(x) for x, _ in links], pa.int64()), "b": pa.array([int(y) for _, y in links], pa.int64())})

    whole = crowded.join(full.select("doc_id", "shingles"), "doc_id")
    return whole.groupBy("place", "value", "x", "y").applyInArrow(connect, "a long, b long")


def rest_links(posts: DataFrame, roots: DataFrame, full: DataFrame, percent: int = PERCENT, threshold: int = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Links on whole sets between what the hubs have left apart: all of the pairs, and of crowded blocks what connects them."""
    found = stored(rest_pairs(posts, roots, full, threshold, block, folded=True), "near-candidates")
    pairs = found.filter("b is not null").select("a", "b").distinct()
    crowded = found.filter("b is null").select(F.col("a").alias("doc_id"), "place", "value", "x", "y")
    return verified(pairs, full, percent).unionByName(block_links(crowded, full, percent))


def near_dedup(docs: DataFrame, percent: int = PERCENT, coordinates: int = COORDINATES, threshold: int = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """Every row of docs (doc_id, text): doc_id, n_shingles, component_id, kept, set_root (the first document of the same set).

    Documents are linked when 100 * intersection >= percent * union of their sets of distinct `width`-word shingles, checked
    on whole sets; component_id is the smallest doc_id reachable. Candidates are pairs whose MinHash signatures agree in
    `threshold` of `coordinates` places, found through posting lists of (place, value). A pair at similarity 0.75 is missed
    with a probability below one in a million by the defaults.

    Documents of one set are folded first. Then each posted document is checked against the hub of its lists, which joins
    most of a large group in as many pairs as it has documents; what is still apart is paired, or, where it is crowded, connected
    block by block on whole sets.

    A text without words (null, empty, white space) has no shingles and is linked with nothing. Rows that share a doc_id are
    one document: what either is linked with, both are. A null doc_id is kept, with a null component. No rows give no rows.
    """
    docs = docs.select("doc_id", "text")
    sketched = stored(sketches(docs, coordinates, width), "near-sketches")
    named = sketched.filter("n_shingles > 0 and doc_id is not null")
    sets = stored(named.groupBy("set_a", "set_b", "n_shingles").agg(F.min(F.struct("doc_id", "sig")).alias("r")).select("set_a", "set_b", "n_shingles", "r.doc_id", "r.sig"), "near-sets")
    posts = stored(postings(sets, threshold), "near-posts")
    wanted = posts.select("doc_id").distinct()
    full = stored(shingle_sets(docs.join(wanted, "doc_id", "left_semi"), width), "near-full")
    first = stored(verified(hub_pairs(posts, threshold), full, percent), "near-links")
    roots = components(first)
    more = stored(rest_links(posts, roots, full, percent, threshold), "near-links")
    roots_of_sets = sets.select("set_a", "set_b", "n_shingles", F.col("doc_id").alias("set_root"))
    same = named.join(roots_of_sets, ["set_a", "set_b", "n_shingles"])
    repeated = same.filter("doc_id <> set_root").select(F.col("set_root").alias("a"), F.col("doc_id").alias("b")).distinct()
    doubled = named.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    # Copies hang on their set's first document, unless a doc_id stands in several rows and so ties sets together.
    ties = repeated.join(doubled, F.col("b") == F.col("doc_id"), "left_semi")
    links = first.unionByName(more).unionByName(ties)
    grouped = components(links)
    found = sketched.select("doc_id", "n_shingles", "set_a", "set_b").join(roots_of_sets, ["set_a", "set_b", "n_shingles"], "left").join(grouped.withColumnRenamed("node", "set_root"), "set_root", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "set_root", "doc_id"))
    return found.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("set_root", "doc_id")).alias("set_root"),
    )


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each group, the smallest doc_id, with the columns of docs."""
    gone = near_dedup(docs).filter("not kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
