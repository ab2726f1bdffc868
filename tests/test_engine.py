"""Closed forms, invariants and brute force for the engine's operators."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarnflow.functions.formula import compiled
from tarnflow.operators import flood, hydraulics, kernels, rain, runoff, skill, terrain, tree
from tarnflow.plans.spec import ModelSpec
from tarnflow.queries import ORACLES, QUERIES
from tarnflow.sources import sinks, tables
from tarnflow.streaming import rain as streams

DS = [1, 2, 3, None, 1, 4, 3, None]
Z = [3.0, 2.0, 1.0, 0.0, 5.0, 9.0, 4.0, 7.0]


@pytest.fixture(scope="module")
def eight(spark):
    rows = [(k, DS[k], 1.0, Z[k], k < 4) for k in range(8)]
    return spark.createDataFrame(rows, "id bigint, ds bigint, dist double, z double, river boolean")


def by_id(df, value):
    return {r["id"]: r[value] for r in df.collect()}


def test_eight_cells(eight):
    assert by_id(flood.nearest_drain(eight), "drain") == {0: 0, 1: 1, 2: 2, 3: 3, 4: 1, 5: 1, 6: 3, 7: None}
    assert by_id(flood.above_drain(eight), "hand") == {0: 0, 1: 0, 2: 0, 3: 0, 4: 3, 5: 7, 6: 4, 7: None}
    assert by_id(tree.accumulate(eight.withColumn("one", F.lit(1)), "one", "a"), "a") == {0: 1, 1: 4, 2: 5, 3: 7, 4: 2, 5: 1, 6: 1, 7: 1}
    bridge = eight.withColumn("z", F.when(F.col("id") < 4, F.element_at(F.array(*map(F.lit, (5.0, 4.0, 6.5, 3.0))), F.col("id").cast("int") + 1)).otherwise(9.0))
    assert by_id(flood.river_beds(bridge), "bed") == {0: 5, 1: 4, 2: 4, 3: 3}
    assert by_id(tree.strahler(eight), "order") == {0: 1, 1: 2, 2: 2, 3: 2, 4: 1, 5: 1, 6: 1, 7: 1}


def test_reaches_of_a_fork(spark):
    rows = [(k, k + 1 if k < 4 else 10, 100.0) for k in range(5)] + [(5 + k, 6 + k if k < 4 else 10, 100.0) for k in range(5)] + [(10 + k, 11 + k if k < 11 else None, 100.0 if k < 11 else None) for k in range(12)]
    found = tree.reaches(spark.createDataFrame(rows, "id bigint, ds bigint, dist double"), 600.0)
    assert sorted(r["n"] for r in found.groupBy("link", "reach").agg(F.count(F.lit(1)).alias("n")).collect()) == [5, 5, 6, 6]


def test_accumulate_within(spark):
    rows = [(k, k + 1 if k < 5 else None, o) for k, o in enumerate([True, True, False, True, True, False])]
    net = spark.createDataFrame(rows, "id bigint, ds bigint, inside boolean").withColumn("one", F.lit(1))
    assert by_id(flood.accumulate_within(net, "inside", "one", "a"), "a") == {0: 1, 1: 2, 3: 1, 4: 2}
    assert [[r["level"] for r in flood.levels(spark, 10, m).collect()] for m in (606, 15, 2e6)] == [[10, 100], [10], [10, 100, 1000, 1e4, 1e5]]


def test_random_trees_against_loops(spark):
    draw = random.Random(0)
    rows = [(k, draw.choice([None, *range(max(0, k - 9), k)]) if k else None, draw.uniform(1, 3), draw.uniform(0, 50)) for k in range(300)]
    net = spark.createDataFrame(rows, "id bigint, ds bigint, dist double, z double")
    most, low, total = {}, {k: z for k, _, _, z in rows}, {k: z for k, _, _, z in rows}
    for k, ds, dist, z in rows:
        most[k] = z if ds is None else max(z, most[ds] + 0.1 * dist)
    for k, ds, dist, _ in reversed(rows):
        if ds is not None:
            low[ds] = min(low[ds], low[k] - 0.1 * dist)
            total[ds] += total[k]
    assert by_id(tree.path_max(net, "z", 0.1, "v"), "v") == pytest.approx(most)
    assert by_id(tree.upstream_min(net, "z", 0.1, "v"), "v") == pytest.approx(low)
    assert by_id(tree.accumulate(net, "z", "v"), "v") == pytest.approx(total)


def test_valley_rating(spark):
    """Flow in a V-shaped valley: 0.75 sqrt(S) / n y^(8/3) / side slope."""
    side, n, s, size = 0.05, 0.05, 0.001, 1.0
    cells = spark.createDataFrame([(0, side * (abs(k) + 0.5) * size, size * size) for k in range(-300, 300)], "reach bigint, hand double, area double")
    cells = cells.withColumn("hand", F.abs("hand"))
    reach = spark.createDataFrame([(0, 1.0, s, 1e-9, 0.0, n)], "reach bigint, length double, slope double, width double, bank double, n double")
    curve = {round(r["y"], 2): r["q"] for r in flood.rating(cells, reach, flood.stages(spark), size * size, n).collect()}
    for y in (2.0, 4.0, 6.0):
        assert curve[y] == pytest.approx(2 * 3 / 8 * math.sqrt(s) / n * y ** (8 / 3) / side, rel=0.08)


@pytest.mark.parametrize("scheme", [*kernels.SCHEMES, "no such scheme"])
def test_routing_keeps_water_and_reaches_equilibrium(scheme):
    n = 40
    plane = pd.DataFrame({"id": range(n), "ds": [*range(1, n), None], "z": np.linspace(20, 12.2, n), "slope": 0.01, "dist": 20.0, "n": 0.05})
    rate = 50 / 1000 / 3600
    out = kernels.route(plane, np.array([rate]), 2.0, 3600, 100, scheme, size=20.0)
    assert (abs(out["rain_m3"] - out["out_m3"] - out["stored_m3"]) <= 1e-9 * out["rain_m3"]).all()
    assert out["q_m3s"].iloc[-1] == pytest.approx(rate * n * 400, rel=0.02)


def test_fill_and_least_cost():
    z = np.full((7, 7), 5.0)
    z[1:6, 1:6], z[3, 3], z[0, 3] = 3.0, 1.0, 4.0
    filled = kernels.filled(z)
    assert (filled[1:6, 1:6] == 4.0).all() and (filled >= z).all()
    code, moves = kernels.least_cost(z), {k: (a, b) for k, a, b in terrain.D8}
    for r in range(7):
        for c in range(7):
            at, steps = (r, c), 0
            while code[at]:
                at, steps = (at[0] + moves[code[at]][0], at[1] + moves[code[at]][1]), steps + 1
                assert steps < 50
            assert at[0] in (0, 6) or at[1] in (0, 6)


def test_lake_at_rest_and_closed_box():
    z = np.random.default_rng(1).uniform(0, 1, (12, 9))
    flow = kernels.Flood2D(z, size=10.0)
    flow.h = np.maximum(3 - z, 0)
    for _ in range(50):
        flow.step(np.zeros_like(z), 100.0)
    assert np.allclose(flow.h + z, 3) and not flow.qx.any()
    flow.h[:] = 0
    t = 0.0
    while t < 300:
        t += flow.step(np.full(z.shape, 1e-3), 300 - t)
    assert flow.h.sum() == pytest.approx(1e-3 * 300 * z.size, rel=1e-9) and (flow.h >= 0).all()


def test_formulas(spark):
    row = spark.createDataFrame([(4.0, 100.0)], "a double, h double")
    names = {"A": F.col("a"), "H": F.col("h")}
    value = lambda text, **k: row.select(compiled(text, names, **k).alias("v")).first()["v"]
    assert value("2*A^0.5 + max(H, 3) / -4") == pytest.approx(-21)
    assert value("A_below(10) + 1", calls={"A_below": lambda z: F.lit(z * 2)}) == 21
    for bad in ("__import__('os')", "A.x", "B", "A if H else 1", "open(3)", "A +", "[1]"):
        with pytest.raises(ValueError):
            compiled(bad, names)


def test_settings():
    spec = ModelSpec(scheme=2)
    assert spec.scheme == "muskingum" and ModelSpec.from_json(spec.to_json()) == spec
    with pytest.raises(ValueError):
        spec.scheme = "magic"
    with pytest.raises(AttributeError):
        spec.colour = 1
    spec.dt, spec.output_interval, spec.abstraction_ratio = 100.0, 10.0, 2.0
    assert len(spec.problems()) == 2


def test_recovery_without_dry_spells_is_plain(spark):
    rain_ = [30 / 1000 / 3600] * 40
    soil = spark.createDataFrame([(1, rain_, 3e-6, 0.15, 0.2)], "id bigint, rain array<double>, ksat double, psi double, dtheta double")
    a, b = runoff.green_ampt(soil, 300.0).first(), runoff.green_ampt_recovering(soil, 300.0).first()
    assert a["infiltrated"] == pytest.approx(b["infiltrated"]) and a["excess"] == pytest.approx(b["excess"])
    assert a["infiltrated"] + a["excess"] == pytest.approx(sum(rain_) * 300)


def test_storm_text_gauges_and_files(spark, tmp_path):
    lines = spark.createDataFrame([('COORD 10.5 -3 "Mill"',), ("GAGES 2024 1 2 3 30 0.5 1.25",)], "value string")
    at, read = tables.storm_text(lines)
    assert at.first().asDict() == {"x": 10.5, "y": -3.0, "name": "Mill"} and [r["depth_mm"] for r in read.orderBy("gauge").collect()] == [0.5, 1.25]
    (tmp_path / "g.csv").write_text("gauge_id,name,easting_m,northing_m\na,A,1,2\nb,B,3,4\n")
    (tmp_path / "t.csv").write_text("time_s,a,b\n0,1,2\n60,3,4\n")
    meta, long = tables.gauges(spark, str(tmp_path / "g.csv"), str(tmp_path / "t.csv"))
    assert meta.count() == 2 and long.count() == 4
    (tmp_path / "t.csv").write_text("time_s,a\n0,1\n")
    with pytest.raises(ValueError, match="b"):
        tables.gauges(spark, str(tmp_path / "g.csv"), str(tmp_path / "t.csv"))
    state = spark.range(5).select("id", (F.col("id") * 2.0).alias("v"))
    grid = state.withColumn("ds", F.lit(None).cast("bigint"))
    sinks.write_state(state, str(tmp_path / "s"), 6, grid, "implicit", ["v"])
    sinks.write_state(state.withColumn("v", F.col("v") + 1), str(tmp_path / "s"), 12, grid, "implicit", ["v"])
    assert [sinks.read_state(spark, str(tmp_path / "s"), h, grid, "implicit", ["v"]).agg(F.sum("v")).first()[0] for h in (6, 12)] == [20, 25]
    sinks.write_hydrograph(spark.createDataFrame([(0.0, 1.0)], "time_s double, q double"), str(tmp_path / "h"))
    assert spark.read.option("header", True).csv(str(tmp_path / "h")).columns == ["time_s", "time_hr", "Q_m3s"]
    with pytest.raises(ValueError):
        tables.hydrograph(state)


def test_metrics(spark):
    rows = [("e", float(t), o, o) for t, o in enumerate((1.0, 4.0, 2.0))]
    r = skill.scores(spark.createDataFrame(rows, "event string, t double, obs double, mod double"), "event").first()
    assert r["nse"] == 1 and r["pbias"] == 0 and r["t_obs"] == 1.0


def test_lone_row_and_ties(spark):
    series = spark.createDataFrame([(1, 0.0, 5.0), (2, 0.0, 3.0), (2, 60.0, 6.0)], "gauge_id bigint, time_s double, depth_mm double")
    found = {(r["gauge_id"], r["time_s"]): r["rate"] for r in rain.rates(series).collect()}
    assert found[2, 60.0] == pytest.approx(1e-4) and found[1, 0.0] == 0
    cells = spark.createDataFrame([(0, 5.0, 0.0)], "id bigint, x double, y double")
    gauges = spark.createDataFrame([(7, 0.0, 0.0), (3, 10.0, 0.0)], "gauge_id bigint, x double, y double")
    assert rain.thiessen(cells, gauges).first()["gauge_id"] == 3


def test_streams_equal_batches(spark, tmp_path):
    rows = [(f"2024-01-01 {h:02d}:00:00", h % 2, float(h)) for h in range(24)]
    frame = spark.createDataFrame(rows, "ts string, gauge_id bigint, depth_mm double").withColumn("ts", F.to_timestamp("ts"))
    frame.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    for name, build, mode in (("w", streams.windowed_depths, "complete"), ("s", streams.storms, "complete")):
        job = build(stream).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        job.awaitTermination(120)
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, build(frame).collect()))
    cells = spark.createDataFrame([(k, float(t), 1e-5 * (1 + t % 3), 60.0) for k in range(3) for t in range(20)], "id bigint, t double, rate double, dt double")
    cells.coalesce(1).write.parquet(str(tmp_path / "cells"))
    job = streams.infiltration(spark.readStream.schema(cells.schema).parquet(str(tmp_path / "cells")), 2e-6, 0.1, 0.2).writeStream.format("memory").queryName("inf").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    job.awaitTermination(120)
    soil = spark.createDataFrame([(k, [1e-5 * (1 + t % 3) for t in range(20)], 2e-6, 0.1, 0.2) for k in range(3)], "id bigint, rain array<double>, ksat double, psi double, dtheta double")
    last = {r["id"]: r["v"] for r in spark.table("inf").groupBy("id").agg(F.max("infiltrated").alias("v")).collect()}
    assert last == pytest.approx(by_id(runoff.green_ampt(soil, 60.0), "infiltrated"))


def test_loops_are_left_out(spark):
    net = spark.createDataFrame([(0, 1, 1.0, 1.0), (1, 2, 1.0, 1.0), (2, 0, 1.0, 1.0), (3, 0, 1.0, 1.0), (4, 5, 1.0, 1.0), (5, None, None, 1.0)], "id bigint, ds bigint, dist double, z double")
    assert by_id(tree.accumulate(net, "z", "a"), "a") == {4: 1, 5: 2}
    assert by_id(tree.descend(net), "root") == {4: 5, 5: 5}
    assert by_id(tree.path_max(net, "z", 0.0, "a"), "a") == by_id(tree.upstream_min(net, "z", 0.0, "a"), "a") == {4: 1, 5: 1}
    assert by_id(tree.strahler(net), "order") == {4: 1, 5: 1}


def test_orders_of_random_trees(spark):
    draw = random.Random(4)
    rows = [(k, draw.randrange(max(0, k - 6), k) if k % 97 else None, 1.0) for k in range(400)]
    order, most = {}, {}
    for k, ds, _ in reversed(rows):
        above = most.get(k, [])
        order[k] = 1 if not above else max(above) + (above.count(max(above)) > 1)
        most.setdefault(ds, []).append(order[k])
    assert by_id(tree.strahler(spark.createDataFrame(rows, "id bigint, ds bigint, dist double")), "order") == order


def test_fill_of_tiles_is_that_of_the_whole_grid(spark):
    draw = np.random.default_rng(2)
    z = draw.uniform(0, 10, (37, 29)) + 0.3 * np.abs(np.arange(29) - 14) - 8 * (draw.random((37, 29)) < 0.1)
    z[10:14, 8:12] = np.nan
    cells = spark.createDataFrame(pd.DataFrame([(r * 29 + c, r, c, z[r, c]) for r in range(37) for c in range(29) if not np.isnan(z[r, c])], columns=["id", "r", "c", "z"]))
    want = kernels.filled(z)
    for tile in (7, 64):
        found = by_id(kernels.fill(cells, tile), "z")
        assert found == {r * 29 + c: want[r, c] for r in range(37) for c in range(29) if not np.isnan(z[r, c])}


def test_formulas():
    from pyspark.sql import functions as F

    for bad in ("1 +", "x y", "import os", "a.b", "f(1)", "max(1", "1 ^", "(2))", "A_below(x)", "", "'a'"):
        with pytest.raises(ValueError):
            compiled(bad, {"x": F.lit(1.0)}, {"A_below": F.lit})


@pytest.mark.parametrize(("text", "value"), [("2^3^2", 512.0), ("-2^2", -4.0), ("2**-1", 0.5), ("1-2-3", -4.0), ("8/4/2", 1.0), ("2*(3+x)", 8.0), ("min(3, 2, x)+1e-3", 1.001), ("- -x", 1.0), ("sqrt(16)*.5", 2.0), ("A_below(30)+1", 31.0)])
def test_precedence(spark, text, value):
    assert spark.range(1).select(compiled(text, {"x": F.lit(1.0)}, {"A_below": lambda z: F.lit(z)}).alias("v")).first()["v"] == pytest.approx(value)


def test_states_of_other_grids_schemes_or_parameters_are_refused(eight, spark, tmp_path):
    state, where = eight.select("id", F.lit(1.5).alias("volume")), f"file://{tmp_path}/state"
    sinks.write_state(state, where, 6.0, eight, "implicit", ["z", "dist"])
    again = lambda grid=eight, scheme="implicit", hours=6.0: sinks.read_state(spark, where, hours, grid, scheme, ["z", "dist"])
    assert sorted(map(tuple, again().collect())) == [(k, 1.5) for k in range(8)]
    assert again(eight.withColumn("z", F.col("z") * (1 + 1e-7))).count() == 8
    for other in (eight.withColumn("z", F.col("z") * 1.01), eight.where("id < 7"), eight.withColumn("ds", F.when(F.col("id") == 6, 2).otherwise(F.col("ds")))):
        with pytest.raises(ValueError):
            again(other)
    with pytest.raises(ValueError):
        again(scheme="kinematic")


def test_points_in_polygons_by_broadcast_and_by_tiles(spark):
    shapes = spark.createDataFrame([("a", [0.0, 10.0, 10.0, 0.0], [0.0, 0.0, 10.0, 10.0]), ("b", [20.0, 30.0, 25.0], [0.0, 0.0, 10.0]), ("c", [5.0, 15.0, 15.0, 5.0], [5.0, 5.0, 15.0, 15.0])], "name string, xs array<double>, ys array<double>")
    points = spark.createDataFrame([(0, 1.0, 1.0), (1, 25.0, 9.0), (2, 21.0, 9.0), (3, 7.0, 7.0), (4, 12.0, 12.0), (5, 50.0, 50.0)], "id bigint, x double, y double")
    for most in (10, 1):
        assert by_id(tables.in_polygon(points, shapes, most), "name") == {0: "a", 1: "b", 2: None, 3: "a", 4: "c", 5: None}


def test_conditioning(spark):
    rows = [(k, 0, k, z, k - 1 if k else None, 1.0, k == 3) for k, z in enumerate((1.0, 3.0, 2.0, 0.5, 5.0))]
    net = spark.createDataFrame(rows, "id bigint, r bigint, c bigint, z double, ds bigint, dist double, lake boolean")
    assert by_id(terrain.conditioned(net, "carve", 0.1), "z") == pytest.approx({0: 1.0, 1: 3.0, 2: 3.1, 3: 0.5, 4: 5.0})
    assert by_id(terrain.conditioned(net, "fill"), "z") == {0: 1.0, 1: 3.0, 2: 2.0, 3: 0.5, 4: 5.0}
    with pytest.raises(ValueError):
        terrain.conditioned(net, "dig")


def test_parameters_by_hand_derived_or_default(spark):
    manual = spark.createDataFrame([(0, 0.3, None), (1, None, 2.0)], "zone bigint, sd double, phi double")
    derived = spark.createDataFrame([(0, 0.9, 0.4), (1, 0.01, 0.4), (2, None, None)], "zone bigint, sd double, phi double")
    found = {r["zone"]: tuple(r)[1:] for r in runoff.resolved(manual, derived, {"sd": 0.2, "phi": 0.35}, 0.05).collect()}
    assert found == {0: (0.3, 0.4, "manual"), 1: (0.05, 2.0, "derived"), 2: (0.2, 0.35, "default")}


def test_nearest_scene_with_large_numbers(spark):
    """Days and the scene's number are one sum, as in the SQL: beyond a million the number outweighs days."""
    rows = [(1, 4.0, 3, 2_500_000), (1, 2.0, 4, 10), (2, 1.0, None, 5), (2, 3.0, 9, 6), (3, 7.0, None, 8)]
    found = runoff.nearest_scene(spark.createDataFrame(rows, "pixel bigint, value double, gap int, scene bigint")).collect()
    assert {r["pixel"]: (r["composite"], r["nearest"]) for r in found} == {1: (3.0, 10), 2: (2.0, 6), 3: (7.0, None)}


def test_pools_against_a_search(spark, monkeypatch):
    """Pools over many tiles, with winding ones that need many hops, in few written rounds."""
    draw = np.random.default_rng(5)
    n = 60
    wet = draw.random((n, n)) < 0.38
    wet[::2, :] = np.where(np.arange(n) < 30, True, wet[::2, :])  # a snake through the left half
    wet[1::2, :30] = False
    wet[1::4, 29], wet[3::4, 0] = True, True
    left, want = {(int(r), int(c)) for r, c in zip(*np.nonzero(wet))}, {}
    while left:
        stack = [left.pop()]
        found = [*stack]
        while stack:
            r, c = stack.pop()
            for x in [(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                if x in left:
                    left.remove(x)
                    stack.append(x)
                    found.append(x)
        want[min(r * n + c for r, c in found)] = len(found)
    rounds, cut = [], flood.cut
    monkeypatch.setattr(flood, "cut", lambda df: rounds.append(1) or cut(df))
    rows = spark.createDataFrame([(int(r * n + c), int(r), int(c)) for r, c in zip(*np.nonzero(wet))], "id bigint, r bigint, c bigint")
    assert {r["pool"]: r["cells"] for r in flood.pools(rows, 7).collect()} == want
    assert len(rounds) <= 14
    assert flood.pools(rows.limit(0)).count() == 0


@pytest.mark.parametrize("every", [1, 7, 10])
def test_muskingum_waves_against_level_by_level(every, monkeypatch):
    """All levels at a time, each a step behind the one above, give what one level after the other gives."""
    draw = np.random.default_rng(every)
    n = 300
    ds = [float(draw.integers(k + 1, min(k + 9, n))) if k < n - 1 and draw.random() < 0.97 else None for k in range(n)]
    cells = pd.DataFrame({"id": np.arange(n), "ds": pd.array(ds, "Float64"), "z": 0.0, "slope": draw.uniform(0.001, 0.1, n), "dist": 30.0, "n": 0.05})
    cells = cells.sample(frac=1.0, random_state=1).reset_index(drop=True)
    rain = np.array([5e-5] * 20 + [0.0])
    turns = []
    monkeypatch.setattr(kernels, "_levels", lambda down: turns.append(1) or [])
    found = kernels.route(cells, rain, 4.0, 70, every, "muskingum")
    assert not turns
    monkeypatch.undo()
    monkeypatch.setattr(kernels, "by_hops", lambda down: [])
    want = kernels.route(cells, rain, 4.0, 70, every, "muskingum")
    assert len(want) == 70 // every and np.allclose(found, want, rtol=1e-11, atol=1e-12)


def test_field_without_an_exchange_of_cells(spark, monkeypatch):
    """Rates in each cell's row are those of joined weights, in one pass or many; gauges without a rate, and times without a gauge, count as in the join."""
    draw = random.Random(3)
    cells = spark.createDataFrame([(k, draw.uniform(0, 99), draw.uniform(0, 99)) for k in range(50)] + [(50, 7.0, 7.0)], "id bigint, x double, y double")
    gauges = spark.createDataFrame([(5, 7.0, 7.0), (2, 50.0, 60.0), (9, 80.0, 10.0)], "gauge_id bigint, x double, y double")
    rates = [(g, float(t), draw.random()) for g in (2, 5, 9, 11) for t in range(8) if (g + t) % 3] + [(11, 99.0, 1.0), (2, 50.0, None), (2, 3.0, 0.5)]
    series = spark.createDataFrame(rates, "gauge_id bigint, t double, value double")
    plain = lambda rows: {(r["id"], r["t"]): -1.0 if r["rate"] is None else r["rate"] for r in rows}
    want = plain(rain.field(rain.idw(cells, gauges), series).collect())
    for most in (1_000_000, 6):
        monkeypatch.setattr(rain, "TIMES", most)
        found = rain.idw_field(cells, gauges, series)
        rows = found.collect()
        assert len(rows) == len(want)
        assert plain(rows) == pytest.approx(want, rel=1e-12)
    assert rain.idw_field(cells, gauges.limit(0), series).isEmpty()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Aggregate(keys=[id" not in plan


def test_dominant_adds_in_the_order_of_the_table(spark, tmp_path):
    """Totals that are equal but for rounding: the rows of an order lie in several files, and sums are those of SQL with one thread."""
    duckdb = pytest.importorskip("duckdb")
    draw = random.Random(1)
    lines = [(k, 500.0 * tax, 1.0, tax) for k in range(300) for tax in draw.choices([0.01, 0.03, 0.06, 0.07, 0.08], k=9)]
    draw.shuffle(lines)
    (tmp_path / "lineitem.parquet").mkdir()
    for f in range(8):
        pd.DataFrame(lines[f::8], columns=["l_orderkey", "l_quantity", "l_extendedprice", "l_tax"]).to_parquet(tmp_path / f"lineitem.parquet/part-{f}.parquet")
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    found = by_id(QUERIES["m_dominant"](spark, str(tmp_path)), "mechanism")
    assert found == dict(con.execute(ORACLES["m_dominant"]).fetchall()) and set(found.values()) == {0, 2}
