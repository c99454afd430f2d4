"""Operators against closed forms and plain numpy."""

import dataclasses
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aeolith.config import DEFAULT
from aeolith.functions.months import season_year, wrap_longitude
from aeolith.functions.numeric import clamp, correlation_p, normal_p, ratio, student_two_sided
from aeolith.operators import bias, cdf, complementarity, contracts, ensemble, geodesy, selection, spatial, stats, trends
from aeolith.sources import files
from aeolith.sources.cubes import finite, release


def one(df):
    return df.collect()[0]


# ---- geometry


def box(west, south, east, north):
    return float(geodesy.box_areas_km2(west, south, east, north)[0])


def clipped(ring, west, south, east, north):
    """A ring cut to a box, side by side."""
    out = list(ring)
    for axis, bound, sign in ((0, west, 1), (0, east, -1), (1, south, 1), (1, north, -1)):
        src, out = out, []
        for a, b in zip(src, [*src[1:], *src[:1]]):
            ia, ib = (sign * p[axis] >= sign * bound for p in (a, b))
            if ia:
                out.append(a)
            if ia != ib:
                t = (bound - a[axis]) / (b[axis] - a[axis])
                cut = [a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])]
                cut[axis] = bound
                out.append(tuple(cut))
    return out


def star(n, r, seed, x=105.0, y=35.0):
    """A ring without crossings of its own."""
    g = np.random.default_rng(seed)
    at = np.sort(g.random(n)) * 2 * np.pi
    size = r * (0.7 + 0.3 * g.random(n))
    return list(zip((x + 1.6 * size * np.cos(at)).tolist(), (y + size * np.sin(at)).tolist()))


def plane(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, [*ring[1:], *ring[:1]])) / 2


@pytest.mark.parametrize("backward", [False, True])
def test_overlaps_are_those_of_cut_rings(monkeypatch, backward):
    """In the plane, where parts of a side add up to the side, so both ways are exact."""
    monkeypatch.setattr(geodesy, "geodesic_bands", lambda lat1, lon1, lat2, lon2: (lat1 + lat2) / 2 * (lon2 - lon1))
    outer, hole, far = star(60, 16, 1), star(20, 4, 2)[::-1], [(60.0, 5.0), (64.0, 5.0), (64.0, 9.0), (60.0, 9.0)]
    rings = [r[::-1] if backward else r for r in (outer, hole, far)]
    g = np.random.default_rng(3)
    boxes = [(float(w), float(s), w + 2.0, s + 2.0) for w in range(58, 150, 2) for s in range(3, 57, 2)]
    boxes += [(w, s, w + a, s + b) for w, s, a, b in zip(g.uniform(60, 140, 200), g.uniform(5, 50, 200), g.uniform(0.1, 9, 200), g.uniform(0.1, 9, 200))] + boxes[:3]
    got = geodesy.Boundary(rings).areas_km2(*zip(*boxes)) * 1e6
    want = [sum(plane(clipped(r, *b)) for r in (outer, hole, far)) for b in boxes]
    np.testing.assert_allclose(got, want, atol=1e-9)
    assert sum(v > 0 for v in want) > 300


def test_sides_on_the_grids_lines():
    """Vertices on corners, sides along rows and columns: cells tile the ring."""
    ring = [(0.0, 0.0), (3.0, 0.0), (3.0, 1.0), (4.0, 1.0), (4.0, 3.0), (2.0, 3.0), (2.0, 2.0), (1.0, 2.0), (1.0, 3.0), (0.0, 3.0)]
    cells = [(w, s) for w in range(-1, 6) for s in range(-1, 5)]
    got = geodesy.Boundary([ring]).areas_km2(*zip(*[(w, s, w + 1, s + 1) for w, s in cells]))
    held = {(w, s) for w in range(4) for s in range(3)} - {(3, 0), (1, 2)}
    np.testing.assert_allclose(got, [box(w, s, w + 1, s + 1) if (w, s) in held else 0 for w, s in cells], rtol=1e-12, atol=1e-9)


def test_large_grids_and_rings_are_quick():
    import time

    at = np.linspace(0, 2 * np.pi, 100_001)[:-1]
    size = 15 + 3 * np.sin(9 * at) + np.random.default_rng(4).uniform(0, 0.02, len(at))
    ring = list(zip((105 + 1.6 * size * np.cos(at)).tolist(), (36 + size * np.sin(at)).tolist()))
    w, s = (x.ravel() for x in np.meshgrid(np.arange(73, 136.7, 0.25), np.arange(15, 60, 0.25)))
    began = time.time()
    b = geodesy.Boundary([ring])
    cut = b.areas_km2(w, s, w + 0.25, s + 0.25)
    assert len(w) > 45_000 and time.time() - began < 10
    assert cut.sum() == pytest.approx(geodesy.polygon_area_km2(ring), rel=1e-4)
    g = np.random.default_rng(7)
    w, s = g.uniform(-180, 170, 10**6), g.uniform(-80, 79, 10**6)
    began = time.time()
    a = geodesy.box_areas_km2(w, s, w + g.uniform(0.1, 2, 10**6), s + 0.5)
    assert time.time() - began < 20 and (a > 0).all()


def test_few_nodes_are_enough_for_short_sides(monkeypatch):
    g = np.random.default_rng(1)
    sides = [g.uniform(-79, 79, 2000), g.uniform(-180, 180, 2000)]
    sides += [x + g.uniform(-0.99, 0.99, 2000) for x in sides]
    a = geodesy.geodesic_bands(*sides)
    monkeypatch.setattr(geodesy, "_SHORT", 0.0)
    np.testing.assert_allclose(a, geodesy.geodesic_bands(*sides), rtol=1e-12, atol=1e-3)


def test_edges():
    assert spatial.edges([15, 16, 17]).tolist() == [14.5, 15.5, 16.5, 17.5]
    assert spatial.edges([17, 16, 15]).tolist() == [17.5, 16.5, 15.5, 14.5]
    for bad in ([15, 17, 16], [15, 15, 16]):
        with pytest.raises(ValueError):
            spatial.edges(bad)


def test_cell_areas_fall_northward_and_do_not_depend_on_longitude():
    lat = spatial.axis_points(15, 54, 1)
    assert len(lat) == 40 and len(spatial.axis_points(73, 135, 1)) == 63
    a = [box(72.5, x - 0.5, 73.5, x + 0.5) for x in lat]
    b = [box(134.5, x - 0.5, 135.5, x + 0.5) for x in lat]
    assert min(a) > 0 and all(x > y for x, y in zip(a, a[1:]))
    np.testing.assert_allclose(a, b, rtol=1e-12)


def test_area_of_the_whole_ellipsoid():
    """Octants whose sides are meridians and the equator have an eighth of the surface: 510065621.724 km2."""
    octant = geodesy.polygon_area_km2([(0, 0), (45, 0), (90, 0), (90, 89.9999999), (0, 89.9999999)])
    assert octant * 8 == pytest.approx(510065621.724, rel=1e-7)


def test_geodesic_box_is_close_to_the_band_between_parallels():
    band = geodesy.SEMI_MAJOR**2 * math.radians(1) / 2 * (geodesy.authalic_q(np.sin(np.radians(31))) - geodesy.authalic_q(np.sin(np.radians(30)))) / 1e6
    assert box(10, 30, 11, 31) == pytest.approx(band, rel=1e-3)


def test_cells_tile_a_polygon(spark):
    ring = [(1.3, 1.2), (4.7, 0.4), (5.1, 3.9), (2.2, 4.6)]
    cells = spark.createDataFrame([(float(x), float(y), x + 1.0, y + 1.0) for x in range(7) for y in range(-1, 6)], "west double, south double, east double, north double")
    o = spatial.overlap(cells, [ring]).toPandas()
    # sides are cut as straight lines and measured as geodesics, so pieces of long sides fit roughly
    assert o.intersection_km2.sum() == pytest.approx(geodesy.polygon_area_km2(ring), rel=1e-3)
    assert o.fraction.between(0, 1).all() and (o.intersects == (o.intersection_km2 > 0)).all()
    assert o.inside.sum() > 0 and (~o.intersects).sum() > 0


def test_regrid(spark):
    src = spark.createDataFrame([(float(y), float(x), 2.0 * y + 3.0 * x) for y in range(4) for x in range(5) if (y, x) != (2, 3)], "lat double, lon double, v double")
    to = spark.createDataFrame([(0.25, 0.5), (3.0, 4.0), (3.0, 1.0), (1.5, 2.5), (-1.0, 0.0), (1.0, 9.0)], "lat double, lon double")
    got = {(r.lat, r.lon): r.v for r in spatial.regrid(src, to, [], "v").collect()}
    assert got[0.25, 0.5] == pytest.approx(2.0) and got[3.0, 1.0] == pytest.approx(9.0)
    assert got[1.5, 2.5] is None and got[-1.0, 0.0] is None and got[1.0, 9.0] is None and got[3.0, 4.0] is None


# ---- statistics


def test_weighted_mean_leaves_out_what_is_missing(spark):
    d = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (math.nan, 5.0), (4.0, 2.0), (6.0, 2.0), (math.nan, 100.0)], "x double, w double")
    assert one(finite(d, "x").agg(stats.weighted_mean(F.col("x"), F.col("w")).alias("m"))).m == pytest.approx(23 / 6)
    assert one(finite(d, "x").where("x is null").agg(stats.weighted_mean(F.col("x"), F.col("w")).alias("m"))).m is None


def test_weighted_quantiles_take_a_value(spark, monkeypatch):
    d = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 1.0), ("a", 3.0, 2.0), ("a", 9.0, 0.0), ("a", None, 7.0)], "k string, x double, w double")
    q = one(stats.weighted_quantiles(d, ["k"], "x", "w", {"low": 0.25, "mid": 0.5, "high": 1.0}))
    assert (q.low, q.mid, q.high) == (1.0, 2.0, 3.0)
    r = np.random.default_rng(9)
    many = spark.createDataFrame([(k, float(np.round(r.lognormal(), 2)), float(r.integers(1, 5))) for k in "ab" for _ in range(400)] + [("c", 1.0, 2.0)] * 3, "k string, x double, w double")
    points = {f"p{i}": i / 10 for i in range(11)}
    monkeypatch.setattr(selection, "ROWS", 100)
    assert sorted(stats.weighted_quantiles(many, ["k"], "x", "w", points, pooled=True).collect()) == sorted(stats.weighted_quantiles(many, ["k"], "x", "w", points).collect())


def test_moments_and_skewness(spark):
    r = np.random.default_rng(1)
    x, w = r.gamma(2, 3, 50), r.integers(1, 9, 50).astype(float)
    d = spark.createDataFrame([("a", float(a), float(b)) for a, b in zip(x, w)], "k string, x double, w double")
    m = one(stats.weighted_moments(d, ["k"], "x", "w"))
    assert m["mean"] == pytest.approx(np.average(x, weights=w)) and m["std"] == pytest.approx(math.sqrt(np.average((x - np.average(x, weights=w)) ** 2, weights=w)))
    assert one(d.agg(stats.skewness("x").alias("s"))).s == pytest.approx(np.mean(((x - x.mean()) / x.std(ddof=1)) ** 3))


def test_guards(spark):
    d = spark.createDataFrame([(1.0, 0.0), (1.0, 2.0), (None, 2.0), (-3.0, 1.0)], "a double, b double")
    got = d.select(ratio(F.col("a"), F.col("b"), 1e-12).alias("r"), clamp(F.col("a")).alias("c")).collect()
    assert [g.r for g in got] == [None, 0.5, None, -3.0] and [g.c for g in got] == [1.0, 1.0, None, 0.0]


def test_months(spark):
    d = spark.createDataFrame([(2000, 12, 350.0), (2001, 1, -190.0), (2001, 2, 180.0)], "y int, m int, lon double")
    got = d.select(season_year(F.col("y"), F.col("m")).alias("s"), wrap_longitude(F.col("lon")).alias("l")).collect()
    assert [g.s for g in got] == [2001, 2001, 2001] and [g.l for g in got] == [-10.0, 170.0, -180.0]


# ---- distribution functions


def test_ranks_with_ties(spark):
    """By windows and by counts of distinct values, against a plain count; NULLs, NaN, zeros of both signs."""
    r = np.random.default_rng(8)
    xs = [*np.round(r.random(60), 1).tolist(), 0.0, -0.0, float("nan"), float("nan"), None, None]
    rows = [(g, i, x) for g in ("a", None) for i, x in enumerate(xs)] + [("all null", 0, None), ("one", 0, 2.0)]
    d = spark.createDataFrame(rows, "k string, i int, x double").repartition(3)
    windows = d.withColumn("rank", cdf.average_rank(["k"], "x")).withColumn("p", cdf.self_cdf(["k"], "x"))
    place = lambda x: -math.inf if x is None else math.inf if math.isnan(x) else x
    for got in (windows.collect(), cdf.tied_ranks(d, ["k"], "x").collect()):
        assert len(got) == len(rows) and {(g.k, g.i) for g in got} == {(k, i) for k, i, _ in rows}
        for g in got:
            own = [x for k, _, x in rows if k == g.k]
            less, same = (sum(f(place(x), place(g.x)) for x in own) for f in (lambda a, b: a < b, lambda a, b: a == b))
            assert g.rank == less + (same + 1) / 2
            nulls = sum(x is None for x in own)
            assert g.p == (None if g.x is None else pytest.approx((less - nulls + same / 2) / (len(own) - nulls)))


def test_cross_and_moving_cdf(spark):
    r = np.random.default_rng(2)
    sample, target = np.round(r.random(40), 1), np.round(r.random(30), 1)
    s = spark.createDataFrame([("a", float(x)) for x in sample], "k string, x double")
    t = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(target)], "k string, i0 int, x double")
    got = {g.i0: g.p for g in cdf.cross_cdf(s, t, ["k"], "x", ["i0"]).collect()}
    for i, x in enumerate(target):
        assert got[i] == pytest.approx(((sample < x).sum() + 0.5 * (sample == x).sum()) / 40)
    moved = {g.i0: g.p for g in cdf.moving_cdf(t, ["k"], "i0", "x", 10).collect()}
    for i, x in enumerate(target):
        start = min(max(i - 5, 0), 20)
        w = target[start : start + 10]
        assert moved[i] == pytest.approx(((w < x).sum() + 0.5 * (w == x).sum()) / 10)


# ---- bias correction: the reference's own self-tests


def cube(spark, values, first):
    rows = [(f"{v}{i}{j}", v, first + t, float(a[t, i, j])) for v, a in values.items() for t in range(a.shape[0]) for i in range(a.shape[1]) for j in range(a.shape[2])]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["cell", "variable", "year", "value"]))


def series(df, column):
    return {(r.cell, r.year): r[column] for r in df.collect()}


def test_factor_two(spark):
    r = np.random.default_rng(20260918)
    ref, ev = r.uniform(2, 12, (30, 2, 3)), r.uniform(4, 24, (26, 2, 3))
    fit, obs, target = cube(spark, {"wind": 2 * ref}, 1959), cube(spark, {"wind": ref}, 1959), cube(spark, {"wind": ev}, 1989)
    by = ["variable", "cell"]
    want = {k: v / 2 for k, v in series(target, "value").items()}
    qm = bias.quantile_mapping(fit, obs, target, by, ["year"], "value")
    qdm = bias.delta_mapping(fit, obs, target, by, ["year"], "value")
    for got in (series(qm, "qm"), series(qdm, "qdm")):
        assert got == pytest.approx(want, rel=1e-10, abs=1e-10)
    assert qm.where("qm_fallback").count() == 0
    assert qdm.where("qdm_tail").count() == 2 * 6  # the smallest and the greatest of 26, without ties


def test_kelvin_ratio(spark):
    r = np.random.default_rng(3)
    ref, ev = r.uniform(270, 300, (30, 2, 3)), r.uniform(275, 305, (26, 2, 3))
    fit, obs, target = cube(spark, {"tas": 1.02 * ref}, 1959), cube(spark, {"tas": ref}, 1959), cube(spark, {"tas": ev}, 1989)
    got = series(bias.quantile_mapping(fit, obs, target, ["variable", "cell"], ["year"], "value"), "qm")
    assert got == pytest.approx({k: v / 1.02 for k, v in series(target, "value").items()}, rel=1e-10)


def test_two_kelvin_in_moving_windows(spark):
    r = np.random.default_rng(20260919)
    ref, ev = r.uniform(270, 300, (56, 2, 3)), r.uniform(272, 305, (86, 2, 3))
    fit, obs, target = cube(spark, {"tas": ref + 2}, 1959), cube(spark, {"tas": ref}, 1959), cube(spark, {"tas": ev}, 2015)
    by = ["variable", "cell"]
    want = {k: v - 2 for k, v in series(target, "value").items()}
    moving = bias.moving_delta_mapping(fit, obs, target, by, "year", "value", config=dataclasses.replace(DEFAULT, window=30))
    assert series(moving, "qdm") == pytest.approx(want, rel=1e-10)
    assert series(bias.delta_mapping(fit, obs, target, by, ["year"], "value"), "qdm") == pytest.approx(want, rel=1e-10)


def test_incomplete_groups_are_left_out(spark):
    fit = spark.createDataFrame([("wind", "a", 1.0), ("wind", "a", None), ("wind", "b", 1.0), ("wind", "b", 2.0)], "variable string, cell string, value double")
    obs = spark.createDataFrame([("wind", c, x) for c in "ab" for x in (1.0, 3.0)], "variable string, cell string, value double")
    target = spark.createDataFrame([("wind", c, 0, 1.5) for c in "ab"], "variable string, cell string, year int, value double")
    got = series(bias.quantile_mapping(fit, obs, target, ["variable", "cell"], ["year"], "value"), "qm")
    assert got["a", 0] is None and got["b", 0] is not None


# ---- ranks and trends


def test_spearman(spark):
    x, y = [1.0, 2.0, 2.0, 4.0, 5.0], [5.0, 3.0, 3.0, 1.0, 2.0]
    d = spark.createDataFrame([("a", a, b) for a, b in zip(x, y)] + [("c", 1.0, b) for b in y], "k string, x double, y double")
    got = {r.k: r.rho for r in complementarity.spearman(d, ["k"], "x", "y", 3).collect()}
    rank = lambda v: pd.Series(v).rank()
    assert got["a"] == pytest.approx(rank(x).corr(rank(y))) and got["c"] is None


def test_tail_probabilities(spark):
    assert student_two_sided(2.228138852, 10) == pytest.approx(0.05, rel=1e-8)
    assert student_two_sided(12.7062047364, 1) == pytest.approx(0.05, rel=1e-8)
    d = spark.createDataFrame([(0.6319, 10, 1.959963985), (None, 10, None)], "rho double, n int, z double")
    a, b = d.select(correlation_p(F.col("rho"), F.col("n")).alias("p"), normal_p(F.col("z")).alias("q")).collect()
    assert a.p == pytest.approx(0.05, abs=1e-4) and a.q == pytest.approx(0.05, rel=1e-7) and b.p is None and b.q is None


def test_mann_kendall_and_slopes(spark):
    r = np.random.default_rng(4)
    x = np.round(np.cumsum(r.normal(0.1, 1, 86)), 1)
    d = spark.createDataFrame([("a", t, float(v)) for t, v in enumerate(x)], "k string, t int, x double")
    m = one(trends.mann_kendall(d, ["k"], "t", "x"))
    s = sum(np.sign(x[j] - x[i]) for i in range(86) for j in range(i + 1, 86))
    _, ties = np.unique(x, return_counts=True)
    assert m.s == s and m.var_s == pytest.approx((86 * 85 * 177 - (ties * (ties - 1) * (2 * ties + 5)).sum()) / 18)
    slopes = [(x[j] - x[i]) / (j - i) for i in range(86) for j in range(i + 1, 86)]
    assert one(trends.theil_sen(d, ["k"], "t", "x")).slope == pytest.approx(np.median(slopes))
    assert one(trends.least_squares(d, ["k"], "t", "x")).slope == pytest.approx(np.polyfit(range(86), x, 1)[0])
    rising = spark.createDataFrame([("a", t, float(t)) for t in range(86)], "k string, t int, x double")
    assert one(trends.mann_kendall(rising, ["k"], "t", "x")).var_s == pytest.approx(71881.67, abs=0.01)


def test_ensembles(spark):
    assert ensemble.least_models(17) == 14
    d = spark.createDataFrame([("a", 1.0), ("a", -2.0), ("a", 4.0), ("b", 1.0), ("b", None), ("b", -1.0)], "k string, x double")
    got = {r.k: r for r in ensemble.sign_agreement(d, ["k"], "x", 2).collect()}
    assert got["a"].agreement == pytest.approx(200 / 3) and got["b"].agreement is None
    st = {r.k: r for r in ensemble.statistics(d, ["k"], "x", 3).collect()}
    assert st["a"]["std"] == pytest.approx(np.std([1, -2, 4])) and st["b"]["mean"] is None and st["b"]["model_count"] == 2


# ---- contracts and files


def test_month_contracts(spark):
    d = spark.createDataFrame([("a", 10, 1), ("a", 12, 2), ("a", 11, 3), ("a", 11, 4), ("b", 10, 1), ("b", 11, 2), ("b", 12, 3)], "k string, ym int, place int")
    got = {r.k: r for r in contracts.month_coverage(d, ["k"], 10, 12).collect()}
    assert got["a"].status == "DUPLICATE_MONTHS" and got["a"].status_by_count == "TIME_COUNT_MISMATCH" and got["b"].status_by_count == "OK"
    assert {(r.k, r.ym, r.issue) for r in contracts.month_issues(d, ["k"], 10, 13).collect()} == {("a", 13, "missing"), ("b", 13, "missing"), ("a", 11, "duplicate")}


def test_files(spark, tmp_path):
    d = spark.createDataFrame([("m", "s", 1, 2.0), ("m", "t", 2, None)], "model string, scenario string, ym int, x double")
    files.write_cube(d, str(tmp_path / "cube"))
    assert spark.read.parquet(str(tmp_path / "cube")).where("scenario = 's'").count() == 1
    (tmp_path / "bom.csv").write_bytes("﻿model,x\nm,1.5\n".encode())
    r = one(files.read_csv(spark, str(tmp_path / "bom.csv"), "model string, x double"))
    assert (r.model, r.x) == ("m", 1.5)
    files.write_csv(d, str(tmp_path / "out"))
    with pytest.raises(ValueError):
        files.write_csv(d.where("x > 9"), str(tmp_path / "none"))
    m = files.manifest(spark, [{"key": "a", "status": "COMPLETE", "counts": {"n": 1}}])
    assert contracts.not_done(spark.createDataFrame([("a",), ("b",)], "key string"), m, ["key"]).collect()[0].key == "b"
    assert files.markdown(d, "t").count("\n") == 6
    assert files.one_match(spark.createDataFrame([("a", "p"), ("a", "q"), ("b", "p")], "k string, path string"), ["k"]).count() == 1
    assert files.union_of_rows([d.select("model"), d.select("x")]).count() == 4


def test_stream_of_events(spark, sf, tmp_path):
    from aeolith.streaming.windows import windowed_means

    src = spark.read.parquet(f"{sf}/events.parquet").select("ts", "event_type", "value")
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    s = windowed_means(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in")).withColumn("w", F.lit(1.0)), "value", "w", width="1 day", by=("event_type",))
    q = s.writeStream.format("memory").queryName("windowed").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("select sum(n) n from windowed").collect()[0].n
    assert got == src.where("value is not null").count()


def test_boundaries(tmp_path):
    import json
    import struct

    ring = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (0.0, 0.0)]
    body = struct.pack("<i4d2i", 5, 0, 0, 1, 1, 1, 4) + struct.pack("<i", 0) + struct.pack("<8d", *[x for p in ring for x in p])
    (tmp_path / "a.shp").write_bytes(bytes(100) + struct.pack(">2i", 1, len(body) // 2) + body)
    with pytest.raises(FileNotFoundError):
        files.read_shapefile(str(tmp_path / "a.shp"))
    for e in (".shx", ".dbf", ".prj"):
        (tmp_path / f"a{e}").write_bytes(b"")
    assert files.read_shapefile(str(tmp_path / "a.shp")) == [ring[:-1]]
    feature = {"type": "Feature", "properties": {"code": "X"}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring]]}}
    (tmp_path / "a.json").write_text(json.dumps({"type": "FeatureCollection", "features": [feature]}))
    assert files.read_rings(str(tmp_path / "a.json")) == [ring[:-1]]
    assert files.select_features([feature], "code", ["X"]) == [feature]
    with pytest.raises(ValueError):
        files.select_features([feature, feature], "code", ["X"])


def test_dry_run(spark):
    from aeolith.operators import orchestration

    d = spark.range(3)
    got = {r.check: r.issues for r in orchestration.validate({"a": d.where("id > 0"), "b": d.where("id > 5")}).collect()}
    assert got == {"a": 2, "b": 0}


# ---- samples, pooled quantiles, audits, batches, files


def bias_samples(spark, n_cells=4, years=6, seed=3, gap=True):
    r = np.random.default_rng(seed)
    rows = []
    for variable, base in (("tas", 280.0), ("rsds", 150.0), ("wind", 0.2)):
        for cell in range(n_cells):
            for role, shift in (("fit", 1.0), ("obs", 0.0), ("target", 2.0)):
                for year in range(years):
                    value = base + shift + float(r.standard_normal()) * base / 40
                    if gap and cell == 0 and role == "obs" and year == 2:
                        value = None
                    rows.append((variable, cell, 1, 10.0 + cell, role, year, value))
    return rows, spark.createDataFrame(rows, "variable string, cell int, month int, weight double, role string, year int, value double")


def plain_correction(rows, variable, cell, value, method):
    pick = lambda role: [v for var, c, _, _, ro, _, v in rows if (var, c, ro) == (variable, cell, role)]
    fit, obs, target = pick("fit"), pick("obs"), pick("target")
    if None in fit + obs + target:
        return None
    sample = fit if method == "qm" else target
    p = (sum(x < value for x in sample) + 0.5 * sum(x == value for x in sample)) / len(sample)
    nodes = np.linspace(0.02, 0.98, 99)
    q = min(max(p, 0.02), 0.98)
    m, o = (float(np.interp(q, nodes, np.quantile(x, nodes))) for x in (fit, obs))
    additive = method == "qdm" and variable == "tas"
    y = value * o / m if not additive and abs(m) > DEFAULT.floors[variable] else value + o - m
    return max(y, 0.0) if variable != "tas" else y


def test_both_methods_in_one_pass(spark):
    rows, d = bias_samples(spark)
    got = bias.correct_samples(d, ["variable", "cell", "month"]).collect()
    assert len(got) == 3 * 4 * 6
    for r in got:
        assert r.complete == (r.cell != 0)
        for m in ("qm", "qdm"):
            want = plain_correction(rows, r.variable, r.cell, r.value, m)
            assert (r[m] is None) == (want is None) and (want is None or r[m] == pytest.approx(want, abs=1e-9))
    few = bias.correct_samples(d.where("not (cell = 1 and year = 0)"), ["variable", "cell", "month"], expected={"fit": 6, "obs": 6, "target": 6})
    assert {r.cell for r in few.where("complete").collect()} == {2, 3}
    plan = bias.correct_samples(d.repartition(3), ["variable", "cell", "month"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 1


def test_one_run_gives_all_tables(spark):
    _, d = bias_samples(spark, gap=False)
    run = bias.variable_run(d, ["variable", "cell", "month"], F.when(F.col("year") < 3, "near").otherwise("late"))
    assert run.qc.count() == 9 and run.signal.count() == 9 and run.period_signal.count() == 18
    assert all(r.samples == 6 and r.n == 24 and r.missing_percent == 0 for r in run.qc.collect())


def test_unknown_variables_are_errors(spark):
    _, d = bias_samples(spark)
    with pytest.raises(Exception, match="no setting for variable"):
        bias.correct_samples(d.withColumn("variable", F.lit("sfcWind")), ["variable", "cell", "month"]).collect()


@pytest.mark.parametrize("kind,most", [("even", 100_000), ("skewed", 200), ("extreme", 200)])
def test_pooled_quantiles(spark, monkeypatch, kind, most):
    """The same values whatever a task may order, and no task orders more than it may."""
    r = np.random.default_rng(6)
    x = np.exp(r.standard_normal(5000) * {"even": 0.1, "skewed": 4, "extreme": 100}[kind])
    x[:2000] = 1.0
    d = spark.createDataFrame([("g", float(v), 1.0) for v in x] + [("h", 5.0, 1.0), ("h", None, 1.0)], "g string, x double, w double")
    if kind == "extreme":
        x = np.concatenate([x, [-1e308, 1e308]])
        d = d.unionByName(spark.createDataFrame([("g", -1e308, 1.0), ("g", 1e308, 1.0)], d.schema))
    monkeypatch.setattr(selection, "ROWS", most)
    monkeypatch.setattr(selection, "PARTS", 8)
    points = {"a": 0.0, "b": 0.013, "c": 0.5, "d": 0.9, "e": 1.0}
    got = {q.g: q for q in stats.pooled_quantiles(d, ["g"], "x", points).collect()}
    np.testing.assert_allclose([got["g"][k] for k in points], np.quantile(x, list(points.values())), rtol=1e-12)
    assert [got["h"][k] for k in points] == [5.0] * 5
    binned, plain = ({q.g: tuple(q) for q in stats.weighted_quantiles(d, ["g"], "x", "w", {"p": 0.3, "q": 0.97}, pooled=b).collect()} for b in (True, False))
    assert binned == plain
    counted = d.where("x is not null").groupBy("g", "x").agg(F.count("*").alias("n"))
    bins = selection.narrowed(counted, ["g"], "x", "n", lambda t: [(p * (t - 1), p * (t - 1) + 1) for p in points.values()]).groupBy("g", "__bin").agg(F.count("*").alias("k"), F.sum("n").alias("n")).collect()
    assert max(b.k for b in bins) <= most and (most > 5000 or sum(b.k for b in bins) < 1100)
    release()


def test_area_statistics_agree(spark):
    r = np.random.default_rng(8)
    rows = [(int(k % 3), None if k % 11 == 0 else float(v), float(k % 4)) for k, v in enumerate(r.standard_normal(600))]
    d = spark.createDataFrame(rows, "g int, x double, w double")
    a, b = (sorted(stats.area_statistics(d, ["g"], "x", "w", pooled=k).collect()) for k in (False, True))
    for p, q in zip(a, b):
        np.testing.assert_allclose(p, q, rtol=1e-9)


def test_axes_as_stored(spark):
    d = spark.createDataFrame([("up", 0, 1.0), ("up", 1, 2.0), ("up", 2, 3.0), ("down", 0, 3.0), ("down", 1, 1.0), ("mixed", 0, 1.0), ("mixed", 1, 3.0), ("mixed", 2, 2.0), ("one", 0, 5.0)], "g string, i int, x double")
    got = {r.g: (r.monotonic, r.regular, r.spacing) for r in contracts.axis(d, ["g"], "x", "i").collect()}
    assert got == {"up": (True, True, 1.0), "down": (True, True, 2.0), "mixed": (False, False, 1.5), "one": (True, True, None)}


def test_alignment_and_coverage(spark):
    d = spark.createDataFrame([(1, "tas"), (1, "rsds"), (2, "tas"), (2, "tas"), (2, "rsds"), (3, "rsds")], "k int, variable string")
    assert sorted(map(tuple, contracts.exact_alignment(d, ["k"], ["tas", "rsds"]).collect())) == [(2, "", "tas"), (3, "tas", "")]
    a, b = d.where("k < 3").select("k"), d.where("k > 1").select("k")
    assert sorted(map(tuple, contracts.exact_coverage(a, b, ["k"]).collect())) == [(1, "first"), (3, "second")]


def test_group_audit(spark):
    rows = [("ok", ym, ym, 280.0, "K") for ym in range(12)] + [("gap", ym, ym, 280.0, "K") for ym in (0, 1, 4)] + [("cold", ym, ym, 20.0, "K") for ym in range(3)] + [("mixed", ym, -ym, 280.0, "K" if ym else "degC") for ym in range(3)]
    rows += [("none", ym, ym, None, "K") for ym in range(3)] + [("twice", 0, 0, 280.0, "K"), ("twice", 0, 1, 280.0, "K")]
    d = spark.createDataFrame([(g, "tas", ym, place, v, u, 0.0) for g, ym, place, v, u in rows], "g string, variable string, ym int, place int, value double, unit string, lat double")
    got = {r.g: (r.status, r.message) for r in contracts.group_audit(d, ["g", "variable"], "place", "value", "unit").collect()}
    assert got["ok"] == ("PASSED", "") and got["gap"] == ("FAILED", "2 months lack between the first and the last") and got["cold"] == ("FAILED", "sampled values under the limit")
    assert got["mixed"] == ("FAILED", "several units: K, degC | months are not stored in order")
    assert got["none"][0] == "FAILED" and got["none"][1].startswith("no sampled value is finite") and got["twice"] == ("FAILED", "a month stands there twice")


def test_pair_audit(spark):
    rows = [(s, g, "tas", ym, ym, 280.0, "K", float(lat), 0.0) for s in ("m", "r") for g in ("same", "less", "grid", "one") for ym in range(12) for lat in range(3)]
    keep = lambda s, g, ym, lat: not (s == "m" and g == "less" and ym > 9) and not (s == "r" and g == "grid" and lat == 2) and not (s == "r" and g == "one")
    d = spark.createDataFrame([x for x in rows if keep(x[0], x[1], x[3], x[7])], "side string, g string, variable string, ym int, place int, value double, unit string, lat double, lon double")
    audits = contracts.group_audit(d, ["side", "g", "variable"], "place", "value", "unit")
    got = {r.g: (r.status, r.message) for r in contracts.pair_audit(audits, d, ["g", "variable"], "side", "m", "r").collect()}
    assert got == {"same": ("PASSED", ""), "less": ("FAILED", "2 of the reference's months lack"), "grid": ("FAILED", "unlike grids")}


def test_a_green_run_has_no_issue(spark):
    """Each check alone is set off by one fault, and none by a right run."""
    from aeolith.operators.orchestration import Expected, audit_production

    rows = [(m, "a", v, ym, c, {"tas": 280.0, "wind": 4.0}[v], {"tas": "K", "wind": "m s-1"}[v]) for m in ("qm", "qdm") for v in ("tas", "wind") for ym in range(24) for c in range(5)]
    kind = "method string, model string, variable string, ym int, cell int, y double, unit string"
    settings = [("a", "nodes", "99"), ("a", "window", "30")]
    table = [("a", v, m, 0.5, 40.0) for v in ("tas", "wind") for m in range(12)]
    want = Expected(("qm", "qdm"), 0, 23, {"nodes": "99", "window": "30"}, {"qc": 12})

    def checks(rows=rows, settings=settings, table=table):
        t = spark.createDataFrame(table, "model string, variable string, month int, fallback_percent double, tail_percent double")
        s = spark.createDataFrame(settings, "model string, name string, value string")
        return sorted({(r.check, r.severity) for r in audit_production(spark.createDataFrame(rows, kind), ["model"], want, s, {"qc": t}).collect()})

    change = lambda where, **new: [tuple(new.get(n, x) for n, x in zip(("method", "model", "variable", "ym", "cell", "y", "unit"), r)) if where(*r) else r for r in rows]
    qm = lambda m, a, v, ym, c, y, u: m == "qm" and v == "tas"
    assert checks() == []
    assert checks([r for r in rows if r[0] == "qm"]) == [("METHOD_MISSING", "FAIL")]
    assert checks(rows + [("raw", *r[1:]) for r in rows if qm(*r)]) == [("METHOD_UNKNOWN", "WARNING")]
    assert checks([r for r in rows if not (qm(*r) and r[3] == 7)]) == [("MONTH_COUNT", "FAIL"), ("MONTH_SEQUENCE", "FAIL")]
    assert checks(rows + [(*r[:3], 24, *r[4:]) for r in rows if qm(*r) and r[3] == 23]) == [("MONTH_COUNT", "FAIL"), ("MONTH_RANGE", "FAIL")]
    assert checks([r for r in rows if not (qm(*r) and r[3] == 7 and r[4] == 2)]) == [("GRID_SIZE", "FAIL")]
    assert checks(rows + [r for r in rows if qm(*r) and r[3] == 7]) == [("GRID_SIZE", "FAIL"), ("MONTH_SEQUENCE", "FAIL")]
    assert checks(change(lambda *r: qm(*r) and r[4] == 1, unit="degC")) == [("UNIT_CONSISTENCY", "FAIL")] and checks(change(qm, unit="degC")) == [("UNIT_VALUE", "FAIL")]
    assert checks(change(lambda *r: qm(*r) and r[3] == 1 and r[4] == 1, y=None)) == [("FINITE_SHARE", "WARNING")] and checks(change(lambda *r: qm(*r) and r[4] == 1, y=None)) == [("FINITE_SHARE", "FAIL")]
    assert checks(change(qm, y=380.0)) == [("PHYSICAL_RANGE", "WARNING")] and checks(change(qm, y=500.0)) == [("PHYSICAL_RANGE", "FAIL")]
    assert checks(settings=settings[:1]) == [("SETTING", "FAIL")] and checks(settings=[("a", "nodes", "99"), ("a", "window", "31")]) == [("SETTING", "FAIL")]
    assert checks(table=table[1:]) == [("TABLE_ROWS", "FAIL")] and checks(table=[table[1], *table[1:]]) == [("TABLE_KEYS", "FAIL")]
    assert checks(table=table + [("b", "tas", m, 0.5, 40.0) for m in range(12)]) == [("TABLE_IDENTITY", "FAIL")]
    assert checks(table=[(*r[:3], 1.5, 60.0) if r[1] == "tas" else r for r in table]) == [("FALLBACK_SHARE", "WARNING"), ("TAIL_SHARE", "WARNING")]


def test_csv_by_name_and_reports(spark, tmp_path):
    (tmp_path / "x.csv").write_text("﻿b,a,c\n1.5,x,9\n", encoding="utf-8")
    r = one(files.read_csv(spark, str(tmp_path / "x.csv"), "a string, b double"))
    assert (r.a, r.b) == ("x", 1.5)
    with pytest.raises(ValueError, match="no z"):
        files.read_csv(spark, str(tmp_path / "x.csv"), "a string, z int")
    d = spark.range(7)
    assert "4 more rows are not shown" in files.markdown(d, "t", limit=3) and "more rows" not in files.markdown(d, "t")
    assert files.report("r", {"t": d}, ["note"]).startswith("# r\n\nnote\n\n## t")
    assert one(files.figure_manifest(spark, {"f": d})) == ("f", "id", 7)
    series = lambda a, b: spark.createDataFrame([("m", k) for k in range(a, b)], "model string, ym int")
    assert [x.ym for x in files.joined_in_time([series(5, 9), series(0, 5)], ["model"]).collect()] == list(range(9))
    with pytest.raises(ValueError, match="several files"):
        files.joined_in_time([series(0, 5), series(4, 9)], ["model"])


def test_union_of_neighbours(spark, tmp_path):
    a, b = [(0, 0), (1, 0), (1, 1), (0, 1)], [(1, 0), (1, 1), (2, 1), (2, 0)]
    (ring,) = files.union_of_rings([a, b])
    assert sorted(ring) == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0), (2, 1)]
    assert geodesy.polygon_area_km2(ring) == pytest.approx(geodesy.polygon_area_km2(a) + geodesy.polygon_area_km2(b), rel=1e-9)
    cells = spark.createDataFrame([(float(w), 0.25, w + 1.0, 0.75) for w in range(-2, 4)], "west double, south double, east double, north double")
    first = sorted(spatial.kept_overlap(cells, [ring], str(tmp_path)).collect())
    assert first == sorted(spatial.overlap(cells, [ring]).collect()) == sorted(spatial.kept_overlap(cells, [ring], str(tmp_path)).collect())
    assert sum(r.intersects for r in first) == 2


def test_addresses(spark):
    from aeolith.functions import text

    d = spark.createDataFrame([("HTTPS://x.org/a/b?c=1#d",), ("http://x.org",), ("no address",), ("http://x.org/a/b/;p",)], "u string")
    got = [tuple(r) for r in d.select(text.normal_url(F.col("u")), text.url_name(F.col("u"))).collect()]
    assert got == [("https://x.org/a/b/", "b"), ("http://x.org/", ""), (None, ""), ("http://x.org/a/b/", "b")]


def test_wrapping_only_beyond_180(spark):
    from aeolith.functions.months import wrap_axis

    d = spark.createDataFrame([("far", 180.0), ("far", 350.0), ("near", 180.0), ("near", -10.0)], "g string, lon double")
    assert sorted(map(tuple, wrap_axis(d, ["g"], "lon").collect())) == [("far", -180.0), ("far", -10.0), ("near", -10.0), ("near", 180.0)]


def test_fixed_values():
    """Constants as they must be, whatever the queries' SQL is made of."""
    from aeolith.functions import text
    from aeolith.operators import diagnostics

    assert DEFAULT.cell_temperature == (4.3, 0.943, 0.028, -1.528) and (DEFAULT.performance_slope, DEFAULT.reference_temperature) == (-0.005, 25.0)
    assert DEFAULT.roughness == (0.37, 0.0881) and (DEFAULT.anemometer_height, DEFAULT.hub_height, DEFAULT.air_density) == (10.0, 100.0, 1.225)
    assert (DEFAULT.low, DEFAULT.high, DEFAULT.nodes, DEFAULT.window) == (0.02, 0.98, 99, 30) and DEFAULT.floors == {"tas": 1.0, "rsds": 1.0, "wind": 0.1}
    assert text.ALLOWED_UNITS["rsds"] == ("wm-2", "wm**-2", "wm^-2", "w/m2") and text.UNIT_WORDS[0] == ("watts", "w") and len(text.UNIT_WORDS) == 10
    assert diagnostics.BOUNDS == ("0.05-0.95", "0.02-0.98") and diagnostics.TAIL_LIMIT == 10.0 and diagnostics.POINTS == (0.01, 0.05, 0.1, 0.5, 0.9, 0.95, 0.99)
    assert contracts.SAMPLE_LIMITS == {"tas": (150.0, 350.0), "rsds": (-5.0, 1500.0), "wind": (0.0, 150.0)} and contracts.PHYSICAL_RANGE[0] == ("tas", 150.0, 190.0, 370.0, 400.0)
    assert ensemble.FAMILIES["wind"] == ("wind", "wind_hub", "sfcWind_10m", "wind_speed_hub", "wpd") and math.isclose(ensemble.least_models(17), 14)


def test_cubes_are_read_by_name(spark, tmp_path):
    from aeolith.sources import cubes

    d = spark.createDataFrame([("m", "s", 1, 5, 280.0, 1.0), ("m", "s", 1, 6, float("nan"), 2.0), ("m", "s", 1, 7, float("inf"), 3.0)], "model string, scenario string, cell int, ym int, tas double, other double")
    d.write.parquet(str(tmp_path / "cube"))
    got = cubes.read_cube(spark, str(tmp_path / "cube"), columns=("tas",))
    assert got.columns == ["model", "scenario", "cell", "ym", "tas"] and [r.tas for r in got.orderBy("ym").collect()] == [280.0, None, None]
    with pytest.raises(ValueError, match="no wind"):
        cubes.read_cube(spark, str(tmp_path / "cube"), columns=("wind",))


FAKE = """
import json, numpy as np

class A:
    def __init__(self, x, dims=()): self.values, self.dims = np.asarray(x), dims
    def isel(self, time): return A(self.values[time], self.dims[1:])
    def transpose(self, *by): return A(self.values.transpose([self.dims.index(b) for b in by]), by)
    def __mul__(self, k): return A(self.values * k)
    def __add__(self, o): return A(self.values + (o.values if isinstance(o, A) else o))
    def __sub__(self, o): return A(self.values - o)
    @property
    def dt(self): return type("T", (), {"year": A([t[0] for t in self.values]), "month": A([t[1] for t in self.values])})

class D(dict):
    def __enter__(self): return self
    def __exit__(self, *a): pass
    def __getitem__(self, k): return D({n: dict.__getitem__(self, n) for n in [*k, "time", "lat", "lon"]}) if isinstance(k, list) else dict.__getitem__(self, k)

class coders:
    class CFDatetimeCoder:
        def __init__(self, use_cftime): pass

def open_dataset(path, decode_times=None):
    raw = json.load(open(path))
    return D({k: A(v, raw["dims"] if k in raw["variables"] else (k,)) for k, v in raw["data"].items()})

def open_datatree(path, engine):
    return {str(i): D({k: A(v, g["dims"] if k in g["variables"] else (k,)) for k, v in g["data"].items()}) for i, g in enumerate(json.load(open(path)))}

def merge(parts, compat):
    return D({k: v for p in parts for k, v in p.items()})
"""


def test_files_of_grids(spark, tmp_path, monkeypatch):
    """With a stand-in for the library: dates of the file's calendar, axes in either order, variables of several groups."""
    import json
    import sys

    (tmp_path / "lib").mkdir()
    (tmp_path / "lib" / "xarray.py").write_text(FAKE)
    monkeypatch.syspath_prepend(str(tmp_path / "lib"))
    spark.sparkContext.addPyFile(str(tmp_path / "lib" / "xarray.py"))
    one_file = lambda names, years: {"dims": ["time", "lon", "lat"], "variables": names, "data": {"time": [[y, 12] for y in years], "lat": [10.0, 20.0], "lon": [1.0, 2.0, 3.0], **{n: [[[y + 10 * i + j for j in range(2)] for i in range(3)] for y in years] for n in names}}}
    for k, years in enumerate(((2000, 2001), (2002,))):
        (tmp_path / f"{k}.nc").write_text(json.dumps(one_file(["tas"], years)))
    got = files.ingest_netcdf(spark, [str(tmp_path / f"{k}.nc") for k in (0, 1)], ["tas"], str(tmp_path / "out"))
    assert got.count() == 3 * 6 and {(r.ym, r.lat, r.lon): r.tas for r in got.collect()}[2001 * 12 + 11, 20.0, 3.0] == 2001 + 20 + 1
    (tmp_path / "e.grib").write_text(json.dumps([one_file(["u10", "t2m"], (2000,)), one_file(["ssrd"], (2000,))]))
    got = files.ingest_netcdf(spark, [str(tmp_path / "e.grib")], ["ssrd", "t2m"], str(tmp_path / "grib"))
    assert got.columns == ["ym", "lat", "lon", "ssrd", "t2m"] and got.count() == 6
    with pytest.raises(Exception, match="no v10"):
        files.ingest_netcdf(spark, [str(tmp_path / "e.grib")], ["v10"], str(tmp_path / "none"))
    sys.modules.pop("xarray", None)


def test_crop(spark):
    d = spark.createDataFrame([(float(a), float(b), (a, b) in ((1, 1), (2, 3))) for a in range(5) for b in range(5)], "lat double, lon double, hit boolean")
    assert sorted((r.lat, r.lon) for r in spatial.crop(d, F.col("hit")).collect()) == [(a, b) for a in (1.0, 2.0) for b in (1.0, 2.0, 3.0)]
    assert spatial.crop(d, F.lit(False)).count() == 0
