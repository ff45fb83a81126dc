"""Gridded wind, current and wave fields looked up at points.

A grid is a long table: dataset ``ds``, axis indices ``ti``/``yi``/``xi``, axis
values ``t_s``/``lat``/``lon`` and one column per component. Points find their
cells from the sorted axis arrays of their dataset (a few hundred values each)
and then meet the grid in an equi join on the indices; points and grid are
never compared pairwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slickwatch.functions import geo
from slickwatch.operators.ordered import grouped_percentiles
from slickwatch.session import cut_lineage, spread

# Fixed values.
WIND_DRIFT = 0.03
PATCH = 3
MAX_WET_OFFSET_M = 15000.0
STABILITY_OFFSETS_H = (-6, -3, 0, 3, 6)
SPATIAL_MARGIN_DEG = 0.05
TEMPORAL_MARGIN_S = 300
COVERAGE_HOURS = 96

Pairs = dict[str, tuple[str, str]]


def axes(grid: DataFrame) -> DataFrame:
    """Sorted axis arrays of each dataset; sizes are grid dimensions."""

    def axis(value, index):
        return F.array_sort(
            F.collect_set(F.struct(F.col(value).alias("v"), F.col(index).alias("i")))
        )

    return grid.groupBy("ds").agg(
        axis("lat", "yi").alias("lats"), axis("lon", "xi").alias("lons"), axis("t_s", "ti").alias("times")
    )


def _count(axis: str, test) -> Column:
    return F.size(F.filter(F.col(axis), test))


def _at_or_before(axis: str, value: Column) -> Column:
    return _count(axis, lambda a: a["v"] <= value)


def _nearest(axis: str, value: Column, last_on_tie: bool) -> Column:
    """0-based place of the axis value nearest to ``value``."""

    def score(a, i):
        tie = -i if last_on_tie else i
        return F.struct(F.abs(a["v"] - value).alias("d"), tie.alias("t"), i.alias("i"))

    return F.array_min(F.transform(F.col(axis), score))["i"]


def _index_at(axis: str, place: Column) -> Column:
    """Index at a 0-based place, null beyond the axis."""
    return F.get(F.col(axis), place.cast("int"))["i"]


def _outside() -> Column:
    return ~(
        F.col("lat").between(F.col("lats")[0]["v"], F.element_at("lats", -1)["v"])
        & F.col("lon").between(F.col("lons")[0]["v"], F.element_at("lons", -1)["v"])
    )


def next_line_lookup(points: DataFrame, grid: DataFrame, wind_factor: float = WIND_DRIFT) -> DataFrame:
    """Total drift velocity by scenario at the nearest time and the first grid
    line at or beyond the point on each axis (not the nearest line).

    Scenario A takes currents, B adds the wind share, C adds wave drift too.
    Missing components count as 0; a missing current or a point outside the
    box is OUT_OF_DOMAIN.
    """
    place = points.join(axes(grid), "ds", "left")

    def beyond(axis, value):
        first = _count(axis, lambda a: a["v"] < F.col(value))
        return _index_at(axis, F.least(first, F.size(axis) - 1))

    place = place.select(
        *points.columns,
        beyond("lats", "lat").alias("yi"),
        beyond("lons", "lon").alias("xi"),
        _index_at("times", _nearest("times", F.col("t_s"), last_on_tie=False)).alias("ti"),
        _outside().alias("_out"),
    )
    cells = grid.select(
        "ds", "ti", "yi", "xi", "u_current", "v_current", "u_wind", "v_wind", "u_stokes", "v_stokes"
    )
    df = place.join(cells, ["ds", "ti", "yi", "xi"], "left")

    def total(axis):
        def val(c):
            return F.coalesce(F.nanvl(F.col(f"{axis}_{c}"), F.lit(None)), F.lit(0.0))

        return (
            val("current")
            + F.when(F.col("scenario").isin("B", "C"), val("wind") * wind_factor).otherwise(0.0)
            + F.when(F.col("scenario") == "C", val("stokes")).otherwise(0.0)
        )

    missing = F.col("u_current").isNull() | F.col("v_current").isNull()
    return df.select(
        *points.columns,
        total("u").alias("u_total"),
        total("v").alias("v_total"),
        F.when(F.coalesce("_out", F.lit(True)) | missing, "OUT_OF_DOMAIN").otherwise("ACTIVE").alias("status"),
    )


def _values(grid: DataFrame, pairs: Pairs) -> DataFrame:
    """Grid cells keyed by index with one struct per component pair; a pair
    with either half missing is null."""
    cols = []
    for name, (u, v) in pairs.items():
        ok = F.col(u).isNotNull() & F.col(v).isNotNull() & ~F.isnan(u) & ~F.isnan(v)
        cols.append(F.when(ok, F.col(u)).alias(f"{name}_u"))
        cols.append(F.when(ok, F.col(v)).alias(f"{name}_v"))
    return grid.select("ds", "ti", "yi", "xi", *cols)


def _placed(points: DataFrame, grid: DataFrame) -> DataFrame:
    """Points with interval starts, fractions and nearest places per axis."""
    df = points.join(axes(grid), "ds", "left")
    for axis, value, tag in (("lats", "lat", "y"), ("lons", "lon", "x"), ("times", "t_s", "t")):
        n = F.size(axis)
        at_or_before = _at_or_before(axis, F.col(value))
        start = F.greatest(F.lit(0), F.least(at_or_before - 1, n - 2))
        df = df.withColumn(f"_{tag}0", start)
        low = F.element_at(axis, (F.col(f"_{tag}0") + 1).cast("int"))["v"]
        high = F.when(n > 1, F.element_at(axis, (F.least(F.col(f"_{tag}0") + 2, n)).cast("int"))["v"])
        df = df.withColumn(f"_{tag}f", (F.col(value) - low) / (high - low))
        df = df.withColumn(f"_{tag}n", _nearest(axis, F.col(value), last_on_tie=True))
        df = df.withColumn(f"_{tag}p", _nearest(axis, F.col(value), last_on_tie=False))
        df = df.withColumns({f"_{tag}i{d}": _index_at(axis, F.col(f"_{tag}0") + d) for d in (0, 1)})
    many = (F.size("lats") > 1) & (F.size("lons") > 1) & (F.size("times") > 1)
    return df.withColumns({"_out": F.coalesce(_outside(), F.lit(True)), "_many": many, "_ti": _index_at("times", F.col("_tn"))})


def _corner_sums(placed: DataFrame, values: DataFrame, pairs: Pairs, key: str) -> DataFrame:
    """Weighted sums over the eight corner cells; null when a corner lacks a
    value or the time lies outside the axis."""
    corners = []
    for dt in (0, 1):
        for dy in (0, 1):
            for dx in (0, 1):
                weight = reduce(
                    lambda a, b: a * b,
                    [F.col(f"_{k}f") if d else F.lit(1.0) - F.col(f"_{k}f") for k, d in (("t", dt), ("y", dy), ("x", dx))],
                )
                corners.append(
                    F.struct(
                        F.col(f"_ti{dt}").alias("ti"),
                        F.col(f"_yi{dy}").alias("yi"),
                        F.col(f"_xi{dx}").alias("xi"),
                        weight.alias("w"),
                    )
                )
    inside = placed.filter(~F.col("_out") & F.col("_many") & F.col("_tf").between(0, 1))
    exploded = inside.select(key, "ds", F.explode(F.array(*corners)).alias("c")).select(
        key, "ds", "c.ti", "c.yi", "c.xi", "c.w"
    )
    sums = []
    for name in pairs:
        full = F.count(f"{name}_u") == 8
        for half in ("u", "v"):
            sums.append(
                F.when(full, F.sum(F.col("w") * F.col(f"{name}_{half}"))).alias(f"{name}_{half}")
            )
    return exploded.join(values, ["ds", "ti", "yi", "xi"], "left").groupBy(key).agg(*sums)


def _patch_cells(placed: DataFrame) -> Column:
    """The nearest cell, then the patch around it row by row, as one array."""
    reach = F.sequence(F.lit(-PATCH), F.lit(PATCH))
    rows = F.filter(
        F.transform(reach, lambda d: F.col("_yp") + d), lambda r: (r >= 0) & (r < F.size("lats"))
    )
    cols = F.filter(
        F.transform(reach, lambda d: F.col("_xp") + d), lambda c: (c >= 0) & (c < F.size("lons"))
    )
    patch = F.flatten(
        F.transform(
            rows,
            lambda r: F.transform(
                cols,
                lambda c: F.struct(
                    _index_at("lats", r).alias("yi"),
                    _index_at("lons", c).alias("xi"),
                    (F.lit(1) + r * 100000 + c).cast("bigint").alias("o"),
                ),
            ),
        )
    )
    nearest = F.array(
        F.struct(
            _index_at("lats", F.col("_yn")).alias("yi"),
            _index_at("lons", F.col("_xn")).alias("xi"),
            F.lit(0).cast("bigint").alias("o"),
        )
    )
    return F.concat(nearest, patch)


def forcing_at(points: DataFrame, grid: DataFrame, pairs: Pairs, key: str = "point_id") -> DataFrame:
    """Bilinear in space and linear in time from the eight corner cells.

    Where that fails inside the box: the nearest cell at the nearest time, then
    the first valid cell of the patch around it in row order, else
    MISSING_DATA. Outside the box the value is 0 and OUT_OF_DOMAIN. Only the
    failing points take the second join.
    """
    # Axes are long arrays, the same for all points of a dataset: only places on them are written.
    placed = cut_lineage(_placed(spread(points, key), grid).drop("lats", "lons", "times"))
    values = _values(grid, pairs)
    first = placed.select(*points.columns, "_out", "_ti", "_yn", "_xn", "_yp", "_xp")
    first = cut_lineage(first.join(_corner_sums(placed, values, pairs, key), key, "left"))
    lacking = reduce(lambda a, b: a | b, [F.col(f"{n}_u").isNull() for n in pairs])
    failing = first.filter(~F.col("_out") & lacking).join(axes(grid), "ds")
    patch = (
        failing.select(key, "ds", F.col("_ti").alias("ti"), F.explode(_patch_cells(failing)).alias("c"))
        .select(key, "ds", "ti", "c.yi", "c.xi", "c.o")
    )
    found = patch.join(values.withColumnsRenamed({f"{n}_{h}": f"_{n}_{h}" for n in pairs for h in "uv"}), ["ds", "ti", "yi", "xi"])
    found = found.groupBy(key).agg(
        *[
            F.min(F.when(F.col(f"_{n}_u").isNotNull(), F.struct("o", f"_{n}_u", f"_{n}_v"))).alias(f"_{n}")
            for n in pairs
        ]
    )
    df = first.join(found, key, "left")
    out = []
    for n in pairs:
        for h in "uv":
            value = F.coalesce(F.col(f"{n}_{h}"), F.col(f"_{n}._{n}_{h}"))
            out.append(F.when(F.col("_out"), 0.0).otherwise(F.coalesce(value, F.lit(0.0))).alias(f"{n}_{h}"))
        known = F.col(f"{n}_u").isNotNull() | F.col(f"_{n}").isNotNull()
        out.append(
            F.when(F.col("_out"), "OUT_OF_DOMAIN").when(known, "VALID").otherwise("MISSING_DATA").alias(f"{n}_status")
        )
    return df.select(*points.columns, *out)


def wet_cells(points: DataFrame, grid: DataFrame, pair: tuple[str, str], key: str = "point_id") -> DataFrame:
    """Position whose forcing a candidate really uses, and its offset.

    Its own position when interpolation works there, else the valid patch cell
    nearest by great circle, else the nearest cell whatever it holds. A point whose
    dataset has no grid has no position and no offset.
    """
    pairs = {"c": pair}
    placed = _placed(points, grid)
    values = _values(grid, pairs)
    first = placed.join(_corner_sums(placed.withColumn("_out", F.lit(False)).filter(~_outside()), values, pairs, key), key, "left")
    cells = grid.select("ds", "ti", "yi", "xi", F.col("lat").alias("g_lat"), F.col("lon").alias("g_lon"))
    patch = (
        first.filter(F.col("c_u").isNull() & F.col("lats").isNotNull())
        .select(key, "ds", "lat", "lon", F.col("_ti").alias("ti"), F.explode(_patch_cells(placed)).alias("c"))
        .select(key, "ds", "lat", "lon", "ti", "c.yi", "c.xi", "c.o")
        .filter("o > 0")
        .join(values, ["ds", "ti", "yi", "xi"])
        .filter("c_u IS NOT NULL")
        .join(cells, ["ds", "ti", "yi", "xi"])
        .groupBy(key)
        .agg(F.min(F.struct(geo.haversine_m("lat", "lon", "g_lat", "g_lon").alias("d"), "o", "g_lat", "g_lon")).alias("_w"))
    )
    df = first.join(patch, key, "left")
    own = F.col("c_u").isNotNull()
    near_lat = F.element_at("lats", (F.col("_yp") + 1).cast("int"))["v"]
    near_lon = F.element_at("lons", (F.col("_xp") + 1).cast("int"))["v"]
    df = (
        df.withColumn("actual_lat", F.when(own, F.col("lat")).otherwise(F.coalesce("_w.g_lat", near_lat)))
        .withColumn("actual_lon", F.when(own, F.col("lon")).otherwise(F.coalesce("_w.g_lon", near_lon)))
        .withColumn("method", F.when(own, "BILINEAR_VALID_OCEAN").otherwise("NEAREST_WET_CELL"))
    )
    df = df.withColumn("offset_m", geo.haversine_m("lat", "lon", "actual_lat", "actual_lon"))
    return df.withColumn(
        "support", F.when(F.col("offset_m") > MAX_WET_OFFSET_M, "INSUFFICIENT_SPATIAL_SUPPORT").otherwise("VALID")
    ).select(*points.columns, "actual_lat", "actual_lon", "method", "offset_m", "support")


def offset_summary(wet: DataFrame, by: list[str]) -> DataFrame:
    """Largest and median offset and unsupported candidates per group; null offsets where no candidate has one."""
    totals = wet.groupBy(*by).agg(
        F.max("offset_m").alias("max_offset_m"),
        F.count_if(F.col("support") != "VALID").alias("unsupported"),
    )
    return totals.join(grouped_percentiles(wet, by, "offset_m", {"median_offset_m": 0.5}, 1.0), by, "left")


def combined_status(wind="wind_status", current="current_status") -> Column:
    w, c = F.col(wind), F.col(current)
    return (
        F.when((w == "OUT_OF_DOMAIN") | (c == "OUT_OF_DOMAIN"), "OUT_OF_DOMAIN")
        .when((w != "VALID") | (c != "VALID"), "MISSING")
        .otherwise("VALID")
    )


def aligned_forcing(points: DataFrame, grid: DataFrame, pairs: Pairs) -> DataFrame:
    """Wind and current at each point with their relative features."""
    df = forcing_at(points, grid, pairs).withColumn("forcing_status", combined_status())
    features = geo.vector_features("wind_u", "wind_v", "current_u", "current_v")
    return df.select("*", *[v.alias(k) for k, v in features.items()])


def group_forcing(df: DataFrame, by: list[str]) -> DataFrame:
    """Means over valid members only; shares over all members."""
    valid = F.col("forcing_status") == "VALID"
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("candidate_count"),
        *[
            F.avg(F.when(valid, F.col(c))).alias(f"mean_{c}")
            for c in ("wind_speed_mps", "current_speed_mps", "wind_current_angle_deg")
        ],
        F.avg(F.col("nearshore_context").cast("double")).alias("nearshore_fraction"),
        F.avg(valid.cast("double")).alias("coverage_fraction"),
    )


def _samples(points: DataFrame, grid: DataFrame, pairs: Pairs, key: str) -> DataFrame:
    """Forcing at T and the hours around it, one row a point and offset ``_dt``."""
    offsets = F.array(*[F.lit(h * 3600) for h in STABILITY_OFFSETS_H])
    samples = points.withColumn("_dt", F.explode(offsets))
    samples = samples.withColumn("t_s", F.col("t_s") + F.col("_dt")).withColumn(
        "_sample", F.concat_ws("/", F.col(key).cast("string"), F.col("_dt").cast("string"))
    )
    return forcing_at(samples, grid, pairs, "_sample")


def _spans(samples: DataFrame, key: str) -> DataFrame:
    wind = F.sqrt(F.col("wind_u") * F.col("wind_u") + F.col("wind_v") * F.col("wind_v"))
    cur = F.sqrt(F.col("current_u") * F.col("current_u") + F.col("current_v") * F.col("current_v"))
    df = samples.select(key, wind.alias("_w"), cur.alias("_c"), geo.bearing_from("wind_u", "wind_v").alias("_d"))
    df = df.groupBy(key).agg(
        (F.max("_w") - F.min("_w")).alias("wind_range"),
        (F.max("_c") - F.min("_c")).alias("current_range"),
        (F.max("_d") - F.min("_d")).alias("_drift"),
    )
    return df.withColumn(
        "dir_drift", F.when(F.col("_drift") > 180, F.lit(360.0) - F.col("_drift")).otherwise(F.col("_drift"))
    ).drop("_drift")


def stability(points: DataFrame, grid: DataFrame, pairs: Pairs, key: str = "point_id") -> DataFrame:
    """Range of speeds and drift of wind direction over T ± 6 hours."""
    return _spans(_samples(points, grid, pairs, key), key)


def aligned_and_stable(points: DataFrame, grid: DataFrame, pairs: Pairs, key: str = "point_id") -> DataFrame:
    """Forcing at each point with ``forcing_status``, and its ranges over T ± 6 hours, from one pass over the grid.

    The sample at T itself is the aligned forcing.
    """
    samples = cut_lineage(_samples(points, grid, pairs, key))
    own = samples.filter("_dt = 0").drop("_dt", "_sample").withColumn("forcing_status", combined_status())
    return own.join(_spans(samples, key), key)


def stability_class(wind_range="wind_range", drift="dir_drift") -> Column:
    w, d = geo.as_col(wind_range), geo.as_col(drift)
    return (
        F.when((w > 6.0) | (d > 45.0), "HIGHLY_VARIABLE")
        .when((w > 3.0) | (d > 25.0), "MODERATELY_VARIABLE")
        .otherwise("STABLE")
    )


def stability_summary(classed: DataFrame, by: list[str]) -> DataFrame:
    high = F.col("n_highly_variable")
    return (
        classed.groupBy(*by)
        .agg(
            *[
                F.count_if(F.col("stability") == c).alias(f"n_{c.lower()}")
                for c in ("STABLE", "MODERATELY_VARIABLE", "HIGHLY_VARIABLE")
            ]
        )
        .withColumn(
            "overall_status", F.when(high == 0, "PASS").when(high < 10, "WARNING").otherwise("FAIL")
        )
    )


def depth_sensitivity(points: DataFrame, grid: DataFrame, surface: tuple[str, str], second: tuple[str, str]) -> DataFrame:
    """Surface against second layer at each point."""
    df = forcing_at(points, grid, {"s": surface, "d": second})

    def speed(n):
        return F.sqrt(F.col(f"{n}_u") * F.col(f"{n}_u") + F.col(f"{n}_v") * F.col(f"{n}_v"))

    return df.select(
        *points.columns,
        F.abs(speed("s") - speed("d")).alias("speed_diff"),
        geo.circular_diff(geo.bearing_to("s_u", "s_v"), geo.bearing_to("d_u", "d_v")).alias("dir_diff"),
    )


def depth_summary(diffs: DataFrame, by: list[str]) -> DataFrame:
    probs = {"median": 0.5, "p95": 0.95}
    speed = grouped_percentiles(diffs, by, "speed_diff", probs, 0.01).withColumnsRenamed(
        {"median": "median_speed_diff", "p95": "p95_speed_diff"}
    )
    turn = grouped_percentiles(diffs, by, "dir_diff", probs, 0.5).withColumnsRenamed(
        {"median": "median_dir_diff", "p95": "p95_dir_diff"}
    )
    ok = (F.col("median_speed_diff") < 0.10) & (F.col("median_dir_diff") < 15.0)
    return speed.join(turn, by).withColumn("status", F.when(ok, "PASS").otherwise("WARNING"))


def dataset_extent(grid: DataFrame) -> DataFrame:
    """Bounds, time range and resolution of each dataset."""
    ax = axes(grid)

    def end(axis, last=False):
        return F.element_at(axis, -1 if last else 1)["v"]

    def step(axis):
        return F.when(F.size(axis) > 1, F.abs(F.element_at(axis, 2)["v"] - F.element_at(axis, 1)["v"]))

    lons = F.transform("lons", lambda a: geo.normalize_lon(a["v"]))
    return ax.select(
        "ds",
        end("lats").alias("lat_min"),
        end("lats", True).alias("lat_max"),
        F.array_min(lons).alias("lon_min"),
        F.array_max(lons).alias("lon_max"),
        end("times").alias("start_s"),
        end("times", True).alias("end_s"),
        geo.rnd(step("lats"), 4).alias("spatial_res_deg"),
        geo.rnd(step("times") / 3600, 2).alias("time_res_hours"),
    )


def coverage_96h(extents: DataFrame, expected: DataFrame, hours: int = COVERAGE_HOURS) -> DataFrame:
    """Each expected dataset: spans the window before its target, or is absent."""
    df = expected.join(extents.select("ds", "start_s", "end_s"), "ds", "left")
    spans = (F.col("start_s") <= F.col("target_s") - hours * 3600) & (F.col("end_s") >= F.col("target_s"))
    return df.withColumn(
        "coverage_status",
        F.when(F.col("start_s").isNull(), "UNAVAILABLE").when(spans, "PASS").otherwise("FAIL"),
    )


def forcing_gate(df: DataFrame, by: list[str], stable: str = "is_stable") -> DataFrame:
    """Counts by status and the alignment gate per group."""
    wind_ok, cur_ok = F.col("wind_status") == "VALID", F.col("current_status") == "VALID"
    out = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("candidates"),
        F.count_if(wind_ok).alias("valid_wind"),
        F.count_if(cur_ok).alias("valid_current"),
        F.count_if(F.col("forcing_status") == "OUT_OF_DOMAIN").alias("out_of_domain"),
        F.count_if(F.col("forcing_status") == "MISSING").alias("missing"),
        F.avg(wind_ok.cast("double")).alias("coverage"),
        F.bool_and(stable).alias("all_stable"),
    )
    ok = (
        (F.col("out_of_domain") == 0)
        & F.col("all_stable")
        & (F.col("valid_wind") == F.col("candidates"))
        & (F.col("valid_current") == F.col("candidates"))
    )
    return out.withColumn("gate", F.when(ok, "PASS").otherwise("FAILED_ALIGNMENT"))


# Evidence types that can supply each field, the components a
# dataset must have, and the prefix of its reason codes.
FIELDS = {
    "current": (("ocean_current", "met_ocean"), True),
    "wind": (("wind", "met_ocean"), True),
    "wave": (("wave", "met_ocean"), False),
}


def coverage_check(
    cases: DataFrame, evidence: DataFrame, hours: float, require_waves: bool = False
) -> DataFrame:
    """Does the evidence of each case cover its spill point and window.

    ``evidence`` rows carry their extent and component flags. They meet the
    cases in an inner join, which may broadcast the cases or split a busy one,
    and are reduced to a row per case; cases without evidence join afterwards.
    """
    joined = evidence.join(cases.select("case_id", "lat", "lon", "obs_s"), "case_id")
    m = SPATIAL_MARGIN_DEG
    inside = F.col("lat").between(F.col("lat_min") - m, F.col("lat_max") + m) & F.col("lon").between(
        F.col("lon_min") - m, F.col("lon_max") + m
    )
    begin = F.col("obs_s") - int(hours * 3600)
    covers = (F.col("start_s") <= begin + TEMPORAL_MARGIN_S) & (F.col("end_s") >= F.col("obs_s") - TEMPORAL_MARGIN_S)
    aggs = []
    for name, (types, needs) in FIELDS.items():
        kind = F.coalesce(F.col("evidence_type").isin(*types), F.lit(False))
        usable = kind & F.col("has_u") & F.col("has_v") if needs else kind
        aggs += [
            F.bool_or(kind).alias(f"{name}_present"),
            F.coalesce(F.bool_or(usable & inside), F.lit(False)).alias(f"{name}_spatial"),
            F.coalesce(F.bool_or(usable & covers), F.lit(False)).alias(f"{name}_temporal"),
            F.min(F.when(usable, F.col("start_s"))).alias(f"{name}_start_s"),
            F.max(F.when(usable, F.col("end_s"))).alias(f"{name}_end_s"),
        ]
    df = cases.select("case_id").join(joined.groupBy("case_id").agg(*aggs), "case_id", "left")
    for name in FIELDS:
        for flag in ("present", "spatial", "temporal"):
            df = df.withColumn(f"{name}_{flag}", F.coalesce(f"{name}_{flag}", F.lit(False)))
    codes = []
    for name in FIELDS:
        if name == "wave" and not require_waves:
            continue
        present = F.col(f"{name}_present")
        codes += [
            F.when(~present, f"missing_{name}_data"),
            F.when(present & ~F.col(f"{name}_spatial"), f"{name}_spatial_gap"),
            F.when(present & ~F.col(f"{name}_temporal"), f"{name}_temporal_gap"),
        ]
    return df.withColumn("reasons", F.array_compact(F.array(*codes))).withColumn(
        "ready", F.size("reasons") == 0
    )
