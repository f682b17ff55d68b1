"""Ordered and ranked work inside a key without pulling the key into one task.

A window partitioned by a route or a source sends every row of that key to one task; a key that holds a third of the
table then holds a third of the cluster's work. The functions here cut each key into ordered chunks, work inside a
chunk, and carry only a bounded summary (a few rows or one count per chunk) from one chunk to the next.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayloom.session import checkpointed

CUTS_PER_KEY = 64
CUT_ACCURACY = 2000
PART_ROWS = 25_000


def day_chunk(ts: str) -> Column:
    """Default chunk of a time-ordered table: the calendar day."""
    return F.to_date(F.col(ts))


def dealt(df: DataFrame, ident: str = "id") -> DataFrame:
    """Rows written once, dealt by the hash of their id over all cores, or fewer parts of `PART_ROWS` rows; a part is in the order of ids.

    Fits read their rows hundreds of times and send one partial result a part and pass. Rows that come as one part a file leave
    cores idle; more parts than cores, or parts of few rows, would cost more for the partial results than for the rows. Draws that go
    by part and row are the same on every run over as many cores."""
    stored = checkpointed(df)
    parts = min(stored.count() // PART_ROWS + 1, max(2, df.sparkSession.sparkContext.defaultParallelism))
    return checkpointed(stored.repartition(parts, ident).sortWithinPartitions(ident))


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly over the cores of the cluster: a small file or a merged exchange comes as one part, and whatever is costly
    per row, or repeated, would run on one core."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))


def with_one_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Adds the columns of a table of one row (an aggregate without keys), read as a scalar subquery: no join, no key."""
    return df.withColumn("_t", one_row.select(F.struct("*")).scalar()).select("*", "_t.*").drop("_t")


def beside(df: DataFrame, summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Joins one row per key; without keys the summary has one row, see `with_one_row`."""
    return df.join(summary, list(keys)) if keys else with_one_row(df, summary)


def value_chunks(df: DataFrame, keys: Sequence[str], value: str, parts: int = CUTS_PER_KEY) -> DataFrame:
    """Adds `_chunk`: which of about `parts` equally filled value ranges of its key a row falls in.

    The cut values are approximate quantiles, built with map-side partial aggregation, and depend on the order in which
    partial results meet. Any cuts give right results downstream as long as every branch of a plan sees the same ones: they are
    checkpointed, a row of at most `parts` values for each key. Better cuts only balance the chunks better."""
    keys = list(keys)
    cuts = df.groupBy(*keys).agg(
        F.array_distinct(
            F.percentile_approx(value, [i / parts for i in range(1, parts)], CUT_ACCURACY)
        ).alias("_cuts")
    )
    tagged = beside(df, checkpointed(cuts), keys)
    return tagged.withColumn("_chunk", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")


def ordered_pass(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    before: int = 0,
    after: int = 0,
    values: Sequence[str] = (),
    add: Callable[[Window], dict[str, Column]] | None = None,
    totals: dict[str, Column] | None = None,
    grand: dict[str, str] | None = None,
) -> DataFrame:
    """Running totals and neighbouring rows in the order of each key, by one exchange of halos.

    Rows are dealt out by (key, chunk) and sorted once; chunks must be monotonic in the order. Beside the rows there is one
    summary per chunk: its sums, its last `before` and its first `after` rows. A window over the summaries of a key, as
    many as it has chunks, turns them into what each chunk lacks: the totals of all earlier chunks, the rows before its first
    and those behind its last. These come to the chunk as a few rows more, with the same exchange, are seen by its windows,
    and are dropped. So the input is read twice and nothing is joined.

    `totals` are cumulative sums, the current row included; `grand` adds a total over the whole key under another name. `add`
    gets the window of a chunk and returns columns that look at `values` of at most `before` rows back and `after` ahead; it
    can use the totals of its own row. Every chunk that exists has a row, so as many neighbouring chunks are enough."""
    keys, order, totals, grand = list(keys), list(order), totals or {}, grand or {}
    base = df.withColumn("_chunk", chunk).withColumns({f"_v_{name}": expr for name, expr in totals.items()})
    local = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    sums = [F.sum(f"_v_{n}").alias(f"_s_{n}") for n in totals]
    if before or after:
        row = F.struct(*order, *[v for v in values if v not in order])
        place = {"_row": row, "_rn": F.row_number().over(local), "_size": F.count("*").over(Window.partitionBy(*keys, "_chunk"))}
        ends = {"_first": F.col("_rn") <= after, "_last": F.col("_rn") > F.col("_size") - before}
        edges = [F.sort_array(F.collect_list(F.when(at, F.col("_row")))).alias(name) for name, at in ends.items()]
        summary = base.withColumns(place).groupBy(*keys, "_chunk").agg(*sums, *edges)
    else:
        summary = base.groupBy(*keys, "_chunk").agg(*sums)
    by_chunk = Window.partitionBy(*keys).orderBy("_chunk")
    earlier = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
    lacking = {f"_o_{n}": F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)) for n in totals}
    lacking |= {f"_g_{n}": F.sum(f"_s_{n}").over(Window.partitionBy(*keys)) for n in grand}
    near = []
    if before:
        rows = F.flatten(F.collect_list("_last").over(by_chunk.rowsBetween(-before, -1)))
        near.append(F.slice(rows, F.greatest(F.size(rows) - before + 1, F.lit(1)), before))
    if after:
        near.append(F.slice(F.flatten(F.collect_list("_first").over(by_chunk.rowsBetween(1, after))), 1, after))
    summary = summary.withColumns(lacking | {"_near": F.concat(*near) if near else F.lit(None)})
    carried = [*lacking]
    parts = [base.withColumn("_kind", F.lit(0))]
    if carried:
        parts.append(summary.select(*keys, "_chunk", *carried, F.lit(2).alias("_kind")))
    if near:
        kinds = F.transform("_near", lambda r: F.struct(F.lit(1).alias("kind"), r.alias("row")))
        if carried:
            nothing = F.struct(F.lit(2).alias("kind"), F.get("_near", F.lit(-1)).alias("row"))
            parts[1:] = [summary.select(*keys, "_chunk", *carried, F.explode(F.concat(F.array(nothing), kinds)).alias("_e")).select(*keys, "_chunk", *carried, F.col("_e.kind").alias("_kind"), "_e.row.*")]
        else:
            parts.append(summary.select(*keys, "_chunk", F.explode("_near").alias("_e")).select(*keys, "_chunk", F.lit(1).alias("_kind"), "_e.*"))
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part, allowMissingColumns=True)
    whole = local.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    if carried:
        both = both.withColumns({c: F.max(c).over(whole) for c in carried}).filter("_kind < 2")
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumns({n: F.sum(f"_v_{n}").over(upto) + F.col(f"_o_{n}") for n in totals})
    both = both.withColumns({alias: F.col(f"_g_{n}") for n, alias in grand.items()})
    both = both.withColumns(add(local)) if add else both
    return both.filter("_kind = 0").drop("_kind", "_chunk", *[f"_v_{n}" for n in totals], *carried)


def with_previous_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    rows: int,
    values: Sequence[str],
    add: Callable[[Window], dict[str, Column]],
    chunk: Column,
    after: int = 0,
) -> DataFrame:
    """Adds window columns that look at most `rows` rows back and `after` rows ahead in the order of each key."""
    return ordered_pass(df, keys, order, chunk, rows, after, values, add)


def with_running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    totals: dict[str, Column],
    chunk: Column | None = None,
    grand: dict[str, str] | None = None,
) -> DataFrame:
    """Adds cumulative sums (current row included) over the order of each key; `grand` also adds the total over the whole key
    under another name. With `chunk` absent the column `_chunk` must exist already."""
    return ordered_pass(df, keys, order, F.col("_chunk") if chunk is None else chunk, totals=totals, grand=grand)


def with_position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    position: str = "pos",
    size: str | None = None,
) -> DataFrame:
    """Adds the 1-based position of each row in its key (and the key's row count under `size`)."""
    grand = {position: size} if size else None
    return with_running_totals(df, keys, order, {position: F.lit(1).cast("long")}, chunk, grand)


def average_rank(df: DataFrame, keys: Sequence[str], value: str, rank: str = "rank", count: str = "n") -> DataFrame:
    """Adds the 1-based rank of each non-NULL value in its key, ties sharing the mean rank, and the non-NULL count.

    Equal values are counted first, so a value that fills a third of the table is one row of the ranking."""
    keys = list(keys)
    ties = checkpointed(df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_ties")))
    chunked = value_chunks(ties, keys, value)
    ranked = with_running_totals(chunked, keys, [value], {"_upto": F.col("_ties")}, None, {"_upto": count})
    table = ranked.select(*keys, value, (F.col("_upto") - (F.col("_ties") - 1) / 2.0).alias(rank), count)
    return df.join(table, [*keys, value], "left")


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, wanted: dict[str, float], parts: int = CUTS_PER_KEY
) -> DataFrame:
    """Exact percentiles with linear interpolation, one row per key.

    Equal values are counted first, before the exchange, and everything after works on those counts. Counts per value
    range say in which range each wanted position lies; only the values of those ranges are sorted. No task ever holds
    the values of a whole key."""
    keys = list(keys)
    base = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_val"))
    counts = checkpointed(base.groupBy(*keys, "_val").agg(F.count("*").alias("_c")))
    tagged = value_chunks(counts, keys, "_val", parts)
    per_chunk = tagged.groupBy(*keys, "_chunk").agg(F.sum("_c").alias("_k"))
    by_chunk = Window.partitionBy(*keys).orderBy("_chunk")
    located = per_chunk.select(
        *keys,
        "_chunk",
        (F.sum("_k").over(by_chunk) - F.col("_k")).alias("_start"),
        F.sum("_k").over(by_chunk).alias("_stop"),
        F.sum("_k").over(Window.partitionBy(*keys)).alias("_n"),
    )
    spots = {name: (F.col("_n") - 1) * F.lit(float(p)) for name, p in wanted.items()}
    inside = F.lit(False)
    for spot in spots.values():
        for place in (F.floor(spot), F.ceil(spot)):
            inside = inside | ((place >= F.col("_start")) & (place < F.col("_stop")))
    needed = located.filter(inside).drop("_stop")
    counted = tagged.join(needed, [*keys, "_chunk"])
    upto = F.sum("_c").over(Window.partitionBy(*keys, "_chunk").orderBy("_val"))
    placed = counted.withColumn("_to", F.col("_start") + upto).withColumn("_from", F.col("_to") - F.col("_c"))

    def at(place: Column) -> Column:
        return F.max(F.when((place >= F.col("_from")) & (place < F.col("_to")), F.col("_val")))

    parts_of = []
    for name, spot in spots.items():
        parts_of += [
            at(F.floor(spot)).alias(f"_lo_{name}"),
            at(F.ceil(spot)).alias(f"_hi_{name}"),
            F.max(spot - F.floor(spot)).alias(f"_w_{name}"),
        ]
    picked = placed.groupBy(*keys).agg(*parts_of)
    return picked.select(
        *keys,
        *[
            (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_w_{n}")).alias(n)
            for n in wanted
        ],
    )
