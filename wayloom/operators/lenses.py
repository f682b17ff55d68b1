"""Competition, market and supplier lenses per cell, the panorama built on them, and its views."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayloom.functions.taxonomy import PROFILES, SEGMENTS, SUPPLIERS, selects
from wayloom.operators.geo import (
    GRID,
    RING_WEIGHTS,
    Grid,
    active_cells,
    cell_center,
    cell_id,
    nearest_zone,
    scatter,
    zone_cells,
)

ENOUGH_SUPPORT = 5
LEVELS = ((2 / 3, "alta"), (1 / 3, "media"))
RANKED = ("competencia_directa", "mercado_total", "proveedores_total", "proveedores_diversidad")
GAP_COLUMNS = ("esperado", "brecha_relativa", "brecha_p10", "brecha_p90")
HIGH_MARKET, LOW_COMPETITION = 0.75, 0.25
CELL = ["fila", "col"]


def element_columns() -> list[str]:
    return (
        ["competencia_directa", "competencia_indirecta"]
        + [f"mercado_{s}" for s in SEGMENTS]
        + [f"proveedores_{s}" for s in SUPPLIERS]
    )


def lens_members(counts: DataFrame, rules: DataFrame) -> DataFrame:
    """Pairs of the data behind each element of each profile. A pair that competes never counts as market or supplier."""
    pairs = counts.groupBy("category", "subcategory").agg(F.sum("n").alias("total"))
    hits = (
        rules.join(pairs, "category")
        .filter(selects(F.col("subcategory")))
        .select("profile", "lens", "element", "category", "subcategory", "total")
        .distinct()
    )
    rivals = hits.filter(F.col("lens") == "competencia")
    others = hits.filter(F.col("lens") != "competencia").join(
        rivals.select("profile", "category", "subcategory").distinct(), ["profile", "category", "subcategory"], "left_anti"
    )
    return rivals.unionByName(others)


def lens_coverage(counts: DataFrame, rules: DataFrame) -> DataFrame:
    """POIs of the whole grid behind each element; 0 means it cannot be measured."""
    found = lens_members(counts, rules).groupBy("profile", "lens", "element").agg(F.sum("total").alias("pois"))
    asked = rules.select("profile", "lens", "element").distinct()
    return asked.join(found, ["profile", "lens", "element"], "left").select(
        "profile", "lens", "element", F.coalesce("pois", F.lit(0)).alias("pois")
    )


def compute_lenses(counts: DataFrame, rules: DataFrame, profiles: Sequence[str] = tuple(PROFILES), grid: Grid = GRID) -> DataFrame:
    """All lenses of all profiles for every active cell, in one plan. Values nothing can measure are NULL, not 0."""
    members = lens_members(counts, rules)
    key = ["profile", "lens", "element"]
    per_cell = members.join(counts, ["category", "subcategory"]).groupBy(*key, *CELL).agg(F.sum("n").alias("n"))
    values = scatter(per_cell, key, "n", RING_WEIGHTS, grid)
    column = F.concat_ws("_", "lens", "element")

    lens_pairs = members.select("profile", "lens", "category", "subcategory").distinct()
    lens_cells = lens_pairs.join(counts, ["category", "subcategory"]).groupBy("profile", "lens", *CELL).agg(F.sum("n").alias("n"))
    near = scatter(lens_cells, ["profile", "lens"], "n", (1.0, 1.0), grid)
    support = near.groupBy("profile", *CELL).agg(
        *[F.sum(F.when(F.col("lens") == x, F.col("v"))).alias(f"apoyo_{x}") for x in ("competencia", "mercado", "proveedores")]
    )

    # one row per cell of the grid at most in each element: its maximum fits a window
    top = F.max("v").over(Window.partitionBy(*key))
    marked = values.withColumns({"_column": column, "_share": F.when(top > 0, F.col("v") / top).otherwise(0.0)})
    wide = marked.groupBy("profile", *CELL).agg(
        *[F.sum(F.when(F.col("_column") == c, F.col("v"))).alias(c) for c in element_columns()],
        F.sum(F.when(F.col("lens") == "mercado", F.col("_share"))).alias("_scaled"),
        F.sum(F.when(F.col("lens") == "proveedores", F.col("v"))).alias("_suppliers"),
        F.count_if((F.col("lens") == "proveedores") & (F.col("v") > 0)).alias("_present"),
    )

    measured = members.select(*key).distinct().withColumn("_data", F.lit(True))
    asked = rules.select(*key).distinct().join(measured, key, "left").withColumn("_column", column)
    flags = asked.groupBy("profile").agg(
        *[F.max(F.when(F.col("_column") == c, F.col("_data"))).alias(f"_has_{c}") for c in element_columns()],
        F.count_if((F.col("lens") == "competencia")).alias("_n_rivals"),
        F.count_if((F.col("lens") == "mercado") & F.col("_data")).alias("_n_market"),
        F.count_if((F.col("lens") == "proveedores") & F.col("_data")).alias("_n_suppliers"),
        F.count_if(F.col("lens") == "proveedores").alias("_n_types"),
    )

    spine = active_cells(counts, grid).withColumn("profile", F.explode(F.array(*[F.lit(p) for p in profiles])))
    joined = spine
    for part in (wide, support):
        joined = joined.join(part, ["profile", *CELL], "left")
    joined = joined.join(flags, "profile", "left")

    def counted(name: str) -> Column:
        """Zero where the element has data but this cell has none; competition is always an observed count."""
        value = F.coalesce(name, F.lit(0.0))
        return (value if name.startswith("competencia") else F.when(F.col(f"_has_{name}"), value)).alias(name)

    market, supply = F.col("_n_market") > 0, F.col("_n_suppliers") > 0
    has_rivals = F.coalesce(F.col("_n_rivals") > 0, F.lit(False))
    return joined.select(
        "profile",
        *CELL,
        "pois_vecindad",
        *[counted(c) for c in element_columns()],
        F.when(market, F.coalesce("_scaled", F.lit(0.0)) / F.col("_n_market")).alias("mercado_total"),
        F.when(supply, F.coalesce("_suppliers", F.lit(0.0))).alias("proveedores_total"),
        F.when(supply, F.coalesce("_present", F.lit(0)) / F.col("_n_types")).alias("proveedores_diversidad"),
        *[F.coalesce(f"apoyo_{x}", F.lit(0.0)).alias(f"apoyo_{x}") for x in ("competencia", "mercado", "proveedores")],
        has_rivals.alias("datos_competencia"),
        F.coalesce(market, F.lit(False)).alias("datos_mercado"),
        F.coalesce(supply, F.lit(False)).alias("datos_proveedores"),
    ).withColumn(
        "lentes_con_datos",
        sum((F.col(f"datos_{x}").cast("int") for x in ("competencia", "mercado", "proveedores")), F.lit(0)),
    )


def percentile_rank(value: str, keys: Sequence[str]) -> Column:
    """Mean-tie percentile of a value among the known ones of its key, NULL for NULL. For tables with one row per cell,
    where a key's rows are at most the cells of the grid; unbounded keys use `chunks.average_rank`."""
    part = Window.partitionBy(*keys)
    upto = F.rank().over(part.orderBy(F.col(value).asc_nulls_last()))
    ties = F.count(value).over(Window.partitionBy(*keys, value))
    return F.when(F.col(value).isNotNull(), (upto + (ties - 1) / 2.0) / F.count(value).over(part))


def confidence() -> dict[str, Column]:
    """Mean over the lenses of min(support / 5, 1), 0 for a lens without data; competition is supported by all POIs near."""
    supports = {"competencia": "pois_vecindad", "mercado": "apoyo_mercado", "proveedores": "apoyo_proveedores"}
    parts = [
        F.when(F.col(f"datos_{lens}"), F.least(F.col(c) / ENOUGH_SUPPORT, F.lit(1.0))).otherwise(0.0)
        for lens, c in supports.items()
    ]
    value = sum(parts, F.lit(0.0)) / 3
    (high, high_name), (mid, mid_name) = LEVELS
    level = F.when(value >= high - 1e-12, high_name).when(value >= mid - 1e-12, mid_name).otherwise("baja")
    return {"confianza": value, "confianza_nivel": level}


def build_panorama(
    counts: DataFrame, rules: DataFrame, zones: DataFrame, gap: DataFrame | None = None,
    profiles: Sequence[str] = tuple(PROFILES), grid: Grid = GRID,
) -> DataFrame:
    """Location, lenses, percentiles, confidence and optional supply gap of every profile and active cell."""
    lenses = compute_lenses(counts, rules, profiles, grid)
    lat, lon = cell_center(F.col("fila"), F.col("col"), grid)
    placed = lenses.join(nearest_zone(zones, grid), CELL).withColumns(
        {"cell_id": cell_id(F.col("fila"), F.col("col")), "lat": lat, "lon": lon}
    )
    ranked = placed.withColumns({f"pct_{c}": percentile_rank(c, ["profile"]) for c in RANKED})
    out = ranked.withColumns(confidence())
    if gap is None:
        return out.withColumns({c: F.lit(None).cast("double") for c in GAP_COLUMNS} | {"modelo_brecha": F.lit(""), "brecha_validada": F.lit(False)})
    return attach_gap(out, gap)


def attach_gap(panorama: DataFrame, gap: DataFrame) -> DataFrame:
    """Precomputed gap by profile and cell; cells of the gap table that are not in the panorama are ignored."""
    columns = ["profile", "cell_id", *GAP_COLUMNS, "modelo_brecha", "brecha_validada"]
    out = panorama.drop(*columns[2:]).join(gap.select(*columns), ["profile", "cell_id"], "left")
    return out.withColumns(
        {"modelo_brecha": F.coalesce("modelo_brecha", F.lit("")), "brecha_validada": F.coalesce("brecha_validada", F.lit(False))}
    )


def attach_industrial(view: DataFrame, counts: DataFrame, grid: Grid = GRID) -> DataFrame:
    """Warehouses and industrial buildings in the cell and the eight around, and their percentile."""
    halls = counts.filter((F.col("category") == "edificio") & F.col("subcategory").isin("warehouse", "industrial"))
    near = scatter(halls.groupBy(*CELL).agg(F.sum("n").alias("n")), [], "n", (1.0, 1.0), grid, "naves_vecindad")
    out = view.join(near, CELL, "left").withColumn("naves_vecindad", F.coalesce("naves_vecindad", F.lit(0.0)))
    return out.withColumn("pct_naves_vecindad", percentile_rank("naves_vecindad", ["profile"]))


def opportunity() -> Column:
    """High market, low direct competition, confidence not low; unknown counts as no."""
    hit = (
        (F.col("pct_mercado_total") >= HIGH_MARKET)
        & (F.col("pct_competencia_directa") <= LOW_COMPETITION)
        & (F.col("confianza_nivel") != "baja")
    )
    return F.coalesce(hit, F.lit(False))


def attach_places(view: DataFrame, places: DataFrame) -> DataFrame:
    out = view.join(places.select("cell_id", "localidad", "calle"), "cell_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit("")) for c in ("localidad", "calle")})


def place_label() -> Column:
    street, town = F.nullif("calle", F.lit("")), F.nullif("localidad", F.lit(""))
    both = F.when(street.isNotNull() & town.isNotNull(), F.concat_ws(", ", street, town))
    return F.coalesce(both, street, town, F.concat(F.lit("cerca de "), "zona_cercana"))


def cell_label() -> Column:
    return F.concat_ws(" · ", place_label(), "cell_id")


def map_link(lat: Column, lon: Column) -> Column:
    spot = F.format_string("%.5f", lat), F.format_string("%.5f", lon)
    return F.concat(F.lit("https://www.openstreetmap.org/?mlat="), spot[0], F.lit("&mlon="), spot[1], F.lit("#map=18/"), spot[0], F.lit("/"), spot[1])


def candidate_cells(view: DataFrame, of_zone: DataFrame | None = None) -> DataFrame:
    """Cells to look at first: opportunities, then by market; low confidence is left out."""
    sub = view.withColumn("oportunidad", opportunity()).filter(F.col("confianza_nivel") != "baja")
    if of_zone is not None:
        sub = sub.join(of_zone.select(*CELL).distinct(), CELL, "left_semi")
    return sub.orderBy(F.desc("oportunidad"), F.desc_nulls_last("mercado_total"), "cell_id")


def candidates_table(view: DataFrame, n: int = 15) -> DataFrame:
    """The first n candidates of each profile with place and map link. Needs the place columns."""
    sub = view.withColumn("oportunidad", opportunity()).filter(F.col("confianza_nivel") != "baja")
    order = [F.desc("oportunidad"), F.desc_nulls_last("mercado_total"), F.asc("cell_id")]
    first = sub.withColumn("puesto", F.row_number().over(Window.partitionBy("profile").orderBy(*order))).filter(F.col("puesto") <= n)
    return first.select(
        "profile", "puesto", "cell_id", "oportunidad", place_label().alias("lugar"), "competencia_directa", "mercado_total",
        "proveedores_total", "confianza_nivel", map_link(F.col("lat"), F.col("lon")).alias("mapa"),
    )


def zone_summary(view: DataFrame, zones: DataFrame, radius_m: float = 1500.0, grid: Grid = GRID) -> DataFrame:
    """Per profile and zone: active cells, opportunities, medians of the lenses, mean confidence. The cells of one zone
    and profile are at most those of the grid, so their medians fit one task."""
    inside = zone_cells(zones, radius_m, grid).select("zone", *CELL)
    joined = view.withColumn("_star", opportunity()).join(inside, CELL)
    return joined.groupBy("profile", "zone").agg(
        F.count("*").alias("celdas_activas"),
        F.count_if(F.col("_star")).alias("celdas_oportunidad"),
        F.median("competencia_directa").alias("competencia_mediana"),
        F.median("mercado_total").alias("mercado_mediana"),
        F.median("proveedores_total").alias("proveedores_mediana"),
        F.median("proveedores_diversidad").alias("diversidad_mediana"),
        F.avg("confianza").alias("confianza_media"),
    )


def describe_lens(view: DataFrame, lens: str) -> DataFrame:
    """Dispersion of one lens per profile: known and unknown cells, zeros, mean, population deviation, CV, quartile range, top."""
    v = F.col(lens)
    q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.75)))
    out = view.groupBy("profile").agg(
        F.count(v).alias("n"),
        F.count_if(v.isNull()).alias("sin_datos"),
        F.avg(F.when(v.isNotNull(), (v == 0).cast("double"))).alias("ceros"),
        F.avg(v).alias("media"),
        F.stddev_pop(v).alias("desviacion"),
        q.alias("_q"),
        F.max(v).alias("maximo"),
    )
    return out.withColumns(
        {"cv": F.col("desviacion") / F.nullif(F.col("media"), F.lit(0.0)), "iqr": F.col("_q")[1] - F.col("_q")[0]}
    ).drop("_q")


def lens_correlations(view: DataFrame, lenses: Sequence[str]) -> DataFrame:
    """Spearman correlation of each pair of lenses per profile, over the cells where both are known."""
    pairs = [(a, b) for i, a in enumerate(lenses) for b in lenses[i + 1 :]]
    out = None
    for a, b in pairs:
        known = view.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select("profile", F.col(a).alias("a"), F.col(b).alias("b"))
        ranks = known.select("profile", percentile_rank("a", ["profile"]).alias("ra"), percentile_rank("b", ["profile"]).alias("rb"))
        one = ranks.groupBy("profile").agg(F.corr("ra", "rb").alias("rho")).withColumn("pair", F.lit(f"{a}~{b}"))
        out = one if out is None else out.unionByName(one)
    return out


def opportunity_share(view: DataFrame, market: str = "mercado_total", rivals: str = "competencia_directa") -> DataFrame:
    """Share of cells above the median market and below the median competition, per profile."""
    medians = view.groupBy("profile").agg(F.median(market).alias("_m"), F.median(rivals).alias("_r"))
    hit = F.coalesce((F.col(market) > F.col("_m")) & (F.col(rivals) < F.col("_r")), F.lit(False))
    return view.join(medians, "profile").groupBy("profile").agg(F.avg(hit.cast("double")).alias("share"))


def available_layers(view: DataFrame, layers: Sequence[str]) -> DataFrame:
    """Layers with at least one known value, per profile."""
    known = view.groupBy("profile").agg(*[F.count(c).alias(c) for c in layers])
    return known.unpivot("profile", list(layers), "layer", "cells").filter(F.col("cells") > 0)


def export_frame(view: DataFrame, profile: str, chosen: DataFrame, profiles: Mapping = PROFILES) -> DataFrame:
    """Chosen cells of one profile: identification, its lenses and percentiles, confidence and link."""
    own = (
        ["competencia_directa", "competencia_indirecta"]
        + [f"mercado_{s}" for s in profiles[profile]["mercado"]] + ["mercado_total"]
        + [f"proveedores_{s}" for s in profiles[profile]["proveedores"]] + ["proveedores_total", "proveedores_diversidad"]
    )
    rows = view.filter(F.col("profile") == profile).join(chosen.select("cell_id").distinct(), "cell_id", "left_semi")
    return rows.select("cell_id", "lat", "lon", "zona_cercana", *own, *[f"pct_{c}" for c in RANKED], "confianza", "confianza_nivel", map_link(F.col("lat"), F.col("lon")).alias("enlace"))
