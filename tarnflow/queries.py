"""Queries of the engine's own operators, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnflow.functions import formula
from tarnflow.operators import flood, hydraulics as hy, implicit, kernels, rain, runoff, skill, terrain, tree
from tarnflow.plans import inputs as i
from tarnflow.plans.inputs import CELLS, D8, DOWN, FACC, GAUGES, LAND, NEAR, NET, RAIN, SIZE
from tarnflow.plans.store import cut, folder, once
from tarnflow.sources import sinks, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def R(*columns: str, digits: int = 6) -> str:
    """``name`` or ``expression AS name``, rounded."""
    out = []
    for c in columns:
        e, _, name = c.rpartition(" AS ")
        out.append(f"round({e or name}, {digits}) AS {name}")
    return ", ".join(out)


# ================================================================ sources
@query(f"WITH {CELLS} SELECT id, r, c, {R('z')} FROM cells")
def src_raster(s, d):
    return rounded(i.cells(s, d).select("id", "r", "c", "z"))


@query(f"WITH {CELLS} SELECT r - 5 AS r, c - 7 AS c, {R('z')} FROM cells WHERE r BETWEEN 5 AND 24 AND c BETWEEN 7 AND 18")
def src_window(s, d):
    return rounded(terrain.window(i.cells(s, d), 5, 7, 20, 12))


def _targets(s, d):
    return s.range(400).select("id", (17.0 + F.col("id") % 20 * 47).alias("x"), (11.0 + F.floor(F.col("id") / 20) * 53).alias("y"))


_TARGETS = "targets AS (SELECT CAST(range AS BIGINT) AS id, 17.0 + range % 20 * 47 AS x, 11.0 + (range // 20) * 53 AS y FROM range(400))"


@query(f"WITH {CELLS}, {_TARGETS} SELECT t.id, {R('z')} FROM targets t LEFT JOIN cells ON cells.c = floor((t.x + 60) / 30) AND cells.r = floor((1000 - t.y) / 30)")
def src_align(s, d):
    return rounded(terrain.align_nearest(i.cells(s, d), _targets(s, d), SIZE, -60.0, 1000.0))


@query(f"""WITH {CELLS}, {_TARGETS}, u AS (SELECT id, (x + 60) / 30 - 0.5 AS u, (1000 - y) / 30 - 0.5 AS v FROM targets),
    k AS (SELECT id, floor(u) + i AS c, floor(v) + j AS r, (1 - abs(u - floor(u) - i)) * (1 - abs(v - floor(v) - j)) AS w FROM u, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j))
    SELECT k.id, {R('sum(w * z) / nullif(sum(CASE WHEN z IS NOT NULL THEN w END), 0) AS z')} FROM k LEFT JOIN cells USING (r, c) GROUP BY k.id""")
def src_align_bilinear(s, d):
    return rounded(terrain.align_bilinear(i.cells(s, d), _targets(s, d), SIZE, -60.0, 1000.0))


@query(f"WITH {CELLS} SELECT cells.id, {R('CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price')} FROM cells LEFT JOIN orders ON o_orderkey = id")
def src_sample(s, d):
    raster = i.table(s, d, "orders").where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    return rounded(terrain.sample(i.cells(s, d).select("id"), raster, "price"))


@query(f"WITH {LAND} SELECT CAST(class_code AS INT) AS class_code, class_name, CAST(root_zone_depth_m AS DOUBLE) AS root_zone_depth_m, CAST(mannings_n AS DOUBLE) AS mannings_n, CAST(impervious_fraction AS DOUBLE) AS impervious_fraction FROM land")
def src_lookup(s, d):
    return tables.lookup(s)


@query(f"WITH {RAIN} SELECT gauge_id, time_s, {R('depth_mm')} FROM series")
def src_gauges(s, d):
    return rounded(i.series(s, d))


@query("SELECT CAST(epoch(o_orderdate) AS DOUBLE) AS time_s, round(greatest(sum(o_totalprice) - 1000000, 0), 4) AS q FROM orders GROUP BY 1")
def src_inflow(s, d):
    daily = i.table(s, d, "orders").groupBy((F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) / 3600).alias("Time_HR")).agg((F.sum("o_totalprice") - 1_000_000).alias("Q"))
    return tables.hydrograph(daily).select("time_s", F.round("q", 4).alias("q"))


@query("""SELECT CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, name FROM (SELECT s_suppkey * 1.5 AS x, s_suppkey - 3.25 AS y, s_name AS name FROM supplier)""")
def src_gag(s, d):
    lines = i.table(s, d, "supplier").select(F.concat(F.lit("COORD "), (F.col("s_suppkey") * F.lit(1.5)).cast("string"), F.lit("  "), (F.col("s_suppkey") - F.lit(3.25)).cast("string"), F.lit(' "'), "s_name", F.lit('"')).alias("value"))
    return tables.storm_text(lines)[0]


@query("SELECT CAST(event_id AS BIGINT) AS event_id, date_diff('minute', TIMESTAMP '2024-01-02', date_trunc('minute', ts)) AS minute, round(value, 6) AS q FROM events WHERE ts >= TIMESTAMP '2024-01-02' AND value >= 0")
def src_obs(s, d):
    e = i.table(s, d, "events").where((F.col("ts") >= F.lit("2024-01-02").cast("timestamp_ntz")) & (F.col("value") >= 0))
    start = F.lit("2024-01-02").cast("timestamp_ntz")
    return e.select("event_id", F.timestamp_diff("MINUTE", start, F.date_trunc("minute", "ts").cast("timestamp_ntz")).alias("minute"), F.round("value", 6).alias("q"))


@query("SELECT 10 + range % 9 * 0.5 AS lon, 45 + (range // 9) * 0.5 AS lat FROM range(45)")
def src_lattice(s, d):
    return tables.lattice(s, 10.0, 45.0, 14.0, 47.0, 0.4, 50).select(F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query("SELECT CAST(s_suppkey AS DOUBLE) AS lat, s_suppkey * 2.0 AS lon, unnest([0, 3600, 7200])::BIGINT AS time, unnest([s_acctbal, NULL, 1.5]) AS depth_mm FROM supplier")
def src_openmeteo(s, d):
    t = i.table(s, d, "supplier")
    reply = F.to_json(F.struct(F.col("s_suppkey").cast("double").alias("latitude"), (F.col("s_suppkey") * F.lit(2.0)).alias("longitude"), F.struct(F.array(*map(F.lit, (0, 3600, 7200))).alias("time"), F.array(F.col("s_acctbal"), F.lit(None).cast("double"), F.lit(1.5)).alias("precipitation")).alias("hourly")))
    return tables.point_forecasts(t.select(reply.alias("value"))).select("lat", "lon", "time", "depth_mm")


@query(f"WITH {CELLS} SELECT r // 10 AS tile_r, c // 10 AS tile_c, count(*) AS cells, count(*) = 100 AS covered FROM cells GROUP BY ALL")
def src_dem_coverage(s, d):
    return i.cells(s, d).groupBy(F.floor(F.col("r") / 10).alias("tile_r"), F.floor(F.col("c") / 10).alias("tile_c")).agg(F.count(F.lit(1)).alias("cells")).withColumn("covered", F.col("cells") == 100)


@query(f"WITH {RAIN} SELECT CAST(gauge_id // 3 AS BIGINT) AS frame, gauge_id AS id, {R('max(rate) * 1e6 AS rate')} FROM rates GROUP BY ALL")
def src_manifest(s, d):
    frames = [i.rates(s, d).where(F.floor(F.col("gauge_id") / 3) == k).select(F.lit(k).cast("bigint").alias("frame"), F.col("gauge_id").alias("id"), "rate") for k in (2, 0, 3, 1)]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return rounded(out.groupBy("frame", "id").agg((F.max("rate") * 1e6).alias("rate")))


# rasters on grids of their own, brought to the cells: codes by the nearest, amounts between four
def _coarse(s, d, value):
    """A raster of 90 m over the cells, (r, c, z)."""
    g = i.cells(s, d).where((F.col("r") % 3 == 1) & (F.col("c") % 3 == 1))
    return g.select(F.floor(F.col("r") / 3).alias("r"), F.floor(F.col("c") / 3).alias("c"), value.alias("z"))


def _aligned(s, d, value, how):
    top = i.side(s, d) * SIZE
    target = i.cells(s, d).select("id", "x", (top - F.col("y")).alias("y"))
    return how(_coarse(s, d, value), target, 3 * SIZE, 0.0, top)


def _raster_sql(value, fallback="NULL"):
    return f"WITH {CELLS}, co AS (SELECT r // 3 AS r, c // 3 AS c, {value} AS v FROM cells WHERE r % 3 = 1 AND c % 3 = 1) SELECT cells.id, coalesce(co.v, {fallback}) AS v FROM cells LEFT JOIN co ON co.r = cells.r // 3 AND co.c = cells.c // 3"


@query(_raster_sql("CASE WHEN id % 7 = 0 THEN NULL ELSE 40 + id % 50 END", "70").replace("AS v FROM cells LEFT", "::DOUBLE AS cn FROM cells LEFT"))
def src_cn(s, d):
    """Curve numbers; what is missing or not above zero has the fallback."""
    raw = _aligned(s, d, F.when(F.col("id") % 7 == 0, F.when(F.col("id") % 2 == 0, -9999.0)).otherwise(40.0 + F.col("id") % 50), terrain.align_nearest)
    return raw.select("id", F.when(F.col("z") > 0, F.col("z")).otherwise(70.0).alias("cn"))


@query(_raster_sql("(id % 11) * 10", "0").replace("AS v FROM cells LEFT", "::INT AS class_code FROM cells LEFT"))
def src_lulc(s, d):
    return _aligned(s, d, (F.col("id") % 11 * 10).cast("double"), terrain.align_nearest).select("id", F.coalesce("z", F.lit(0.0)).cast("int").alias("class_code"))


@query(_raster_sql("id % 17 + 1", "0").replace("AS v FROM cells LEFT", "::INT AS class_code FROM cells LEFT"))
def src_lcz(s, d):
    return _aligned(s, d, (F.col("id") % 17 + 1).cast("double"), terrain.align_nearest).select("id", F.coalesce("z", F.lit(0.0)).cast("int").alias("class_code"))


def _bilinear_sql(value, out):
    return f"""WITH {CELLS}, co AS (SELECT r // 3 AS r, c // 3 AS c, {value} AS z FROM cells WHERE r % 3 = 1 AND c % 3 = 1), u AS (SELECT id, x / 90 - 0.5 AS u, y / 90 - 0.5 AS v FROM cells),
    k AS (SELECT id, floor(u) + i AS c, floor(v) + j AS r, (1 - abs(u - floor(u) - i)) * (1 - abs(v - floor(v) - j)) AS w FROM u, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j))
    SELECT k.id, {R(out)} FROM k LEFT JOIN co USING (r, c) GROUP BY k.id"""


_MEAN = "sum(w * z) / nullif(sum(CASE WHEN z IS NOT NULL THEN w END), 0)"


@query(_bilinear_sql("5 + id % 40", f"0.5 * coalesce({_MEAN}, 12) AS ksat_mm_h"))
def src_ksat(s, d):
    """Conductivities between raster cells, scaled; missing ones have the fallback."""
    raw = _aligned(s, d, 5.0 + F.col("id") % 40, terrain.align_bilinear)
    return rounded(raw.select("id", (0.5 * F.coalesce("z", F.lit(12.0))).alias("ksat_mm_h")))


@query(_bilinear_sql("0.05 + id % 30 / 100.0", f"least(greatest(coalesce({_MEAN}, 0.2), 0.05), 1) AS deficit_m"))
def src_deficit(s, d):
    raw = _aligned(s, d, 0.05 + F.col("id") % 30 / 100, terrain.align_bilinear)
    return rounded(raw.select("id", F.least(F.greatest(F.coalesce("z", F.lit(0.2)), F.lit(0.05)), F.lit(1.0)).alias("deficit_m")))


@query(f"""WITH {CELLS}, co AS (SELECT r // 3 AS r, c // 3 AS c, id * 7 % 101 AS sand, (100 - id * 7 % 101) * (id % 11) / 10.0 AS clay FROM cells WHERE r % 3 = 1 AND c % 3 = 1), tx AS (SELECT *, 100 - sand - clay AS silt FROM co)
    SELECT cells.id, coalesce(k.class, 'loam') AS class FROM cells LEFT JOIN (SELECT r, c, CASE {' '.join(f"WHEN {rule} THEN '{name}'" for name, rule in runoff.TRIANGLE)} ELSE 'loam' END AS class FROM tx) k ON k.r = cells.r // 3 AND k.c = cells.c // 3""")
def src_texture(s, d):
    """Classes of sand and clay rasters."""
    k = F.col("id")
    sand = (k * 7 % 101).cast("double")
    both = _aligned(s, d, sand, terrain.align_nearest).withColumnRenamed("z", "sand").join(_aligned(s, d, (100 - sand) * (k % 11) / 10, terrain.align_nearest).withColumnRenamed("z", "clay"), "id")
    return both.transform(runoff.texture).select("id", "class")


@query("""WITH t AS (SELECT n_nationkey AS k, n_name AS name, n_nationkey % 5 * 100 AS x, n_nationkey // 5 * 100 AS y FROM nation), p AS (SELECT s_suppkey AS id, s_suppkey * 37.5 % 500 AS px, s_suppkey * 71.25 % 500 AS py FROM supplier)
    SELECT id, min(name) AS name FROM p LEFT JOIN t ON px >= x AND px < x + 100 AND py >= y AND py < y + 100 - (px - x) GROUP BY id""")
def src_hydroatlas(s, d):
    """The basin of each point: triangles that fill half of a lattice."""
    k = F.col("n_nationkey")
    x, y = (k % 5 * 100).cast("double"), (F.floor(k / 5) * 100).cast("double")
    shapes = i.table(s, d, "nation").select(F.col("n_name").alias("name"), F.array(x, x + 100, x).alias("xs"), F.array(y, y, y + 100).alias("ys"))
    points = i.table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * F.lit(37.5) % 500).alias("x"), (F.col("s_suppkey") * F.lit(71.25) % 500).alias("y"))
    return tables.in_polygon(points, shapes)


# ================================================================ terrain
@query(f"WITH {NET} SELECT id, CAST(code AS INT) AS code, ds, {R('dist')} FROM flow")
def t_d8_steepest(s, d):
    return rounded(i.flow(s, d).select("id", "code", "ds", "dist"))


@query(f"""WITH {CELLS}, {D8}, ways AS (SELECT id, z, code, (r + dr) * n + c + dc AS nid FROM cells, d8 WHERE r + dr BETWEEN 0 AND n - 1 AND c + dc BETWEEN 0 AND n - 1)
    SELECT cells.id, CAST(b.code AS INT) AS code FROM cells LEFT JOIN (SELECT w.id, w.code FROM ways w JOIN cells o ON o.id = w.nid WHERE w.z > o.z
    QUALIFY row_number() OVER (PARTITION BY w.id ORDER BY w.z - o.z DESC, w.code) = 1) b USING (id)""")
def t_d8_drop(s, d):
    return kernels.d8(i.cells(s, d), i.side(s, d), SIZE, "drop").select("id", "code")


@query(f"WITH {NET} SELECT id, CASE WHEN r * c % 13 <> 5 THEN f.ds END AS ds FROM (SELECT f.*, o.id IS NOT NULL AS hit FROM flow f LEFT JOIN flow o ON o.id = f.ds) f")
def t_ds(s, d):
    net = i.net(s, d)
    out = terrain.downstream(net.select("id", "r", "c", F.when(F.col("r") * F.col("c") % 13 != 5, F.col("code")).alias("code")), i.side(s, d), SIZE)
    return out.select("id", "ds")


@query(f"""WITH {NET} SELECT f.id, {R('greatest(coalesce((f.z - o.z) / f.dist, (b.z - f.z) / f.dist0, 1e-4), 1e-4) AS slope')}
    FROM (SELECT flow.*, coalesce(flow.dist, {SIZE}) AS dist0, id - (dr * n + dc) AS back FROM flow LEFT JOIN d8 USING (code)) f LEFT JOIN flow o ON o.id = f.ds LEFT JOIN flow b ON b.id = f.back""")
def t_slope(s, d):
    return rounded(terrain.slope(i.net(s, d), i.side(s, d), SIZE))


@query(f"WITH RECURSIVE {FACC} SELECT id, facc FROM net")
def t_facc(s, d):
    return i.net(s, d).select("id", "facc")


@query(f"WITH RECURSIVE {FACC} SELECT id, row_number() OVER (ORDER BY facc, r, c) - 1 AS pos FROM net")
def t_topo(s, d):
    return terrain.ordered(i.net(s, d).select("id", "facc", "r", "c")).select("id", "pos")


@query(f"WITH RECURSIVE {DOWN} SELECT src AS id, CAST(max(hops) AS BIGINT) AS hops, {R('max(length) AS length')} FROM down GROUP BY src")
def t_bfs(s, d):
    return rounded(i.net(s, d).select("id", "hops", "length"))


@query(f"WITH RECURSIVE {FACC} SELECT id, facc FROM net WHERE facc > greatest(1, n * n // 100)")
def t_stream(s, d):
    n = i.side(s, d)
    return i.net(s, d).where(F.col("facc") > max(1, n * n // 100)).select("id", "facc")


@query(f"WITH RECURSIVE {FACC}, st AS (SELECT * FROM net WHERE facc > greatest(1, n * n // 100)), p AS (SELECT s_suppkey AS k, s_suppkey * 37 % n AS pr, s_suppkey * 53 % n AS pc FROM supplier, n0 WHERE s_suppkey < 10) SELECT k AS gauge_id, arg_min(id, (r - pr) ** 2 + (c - pc) ** 2 + id * 1e-9) AS cell FROM p, st GROUP BY k")
def t_snap_out(s, d):
    n = i.side(s, d)
    points = i.gauges(s, d).select("gauge_id", F.floor(F.col("x") / SIZE).cast("double").alias("x"), F.floor(F.col("y") / SIZE).cast("double").alias("y"))
    stream = i.net(s, d).where(F.col("facc") > max(1, n * n // 100)).select("id", F.col("c").cast("double").alias("x"), F.col("r").cast("double").alias("y"))
    return rain.nearest_of_many(stream, points)


@query(f"WITH RECURSIVE {FACC}, o AS (SELECT id FROM net WHERE r = n // 2 ORDER BY facc DESC, id LIMIT 1) SELECT src AS id FROM down, o WHERE cur = o.id")
def t_basin(s, d):
    net, n = i.net(s, d), i.side(s, d)
    outlet = net.where(F.col("r") == n // 2).orderBy(F.desc("facc"), "id").select("id").first()["id"]
    return tree.descend(net.withColumn("out", F.col("id") == outlet), "out").where("root is not null").select("id")


@query(f"WITH {NET} SELECT id FROM flow WHERE ds IS NULL")
def t_whole(s, d):
    net = i.net(s, d)
    return net.join(net.select(F.col("id").alias("ds")), "ds", "left_anti").select("id")


@query(f"WITH {CELLS} SELECT id, {R('CASE WHEN c % 5 <> 0 THEN z ELSE -9999 END AS z')} FROM cells")
def t_clip(s, d):
    grid = i.cells(s, d)
    return rounded(terrain.clip(grid, grid.where("c % 5 <> 0"), -9999.0).select("id", "z"))


@query()
def t_strahler(s, d):
    return tree.strahler(i.net(s, d).select("id", "ds", "dist"))


@query(f"WITH RECURSIVE {DOWN} SELECT a.src AS id, {R('CASE WHEN b.z IS NULL OR a.length = 0 THEN 0 ELSE (f.z - b.z) / a.length END AS slope')} FROM (SELECT src, arg_max(cur, hops) AS cur, max(length) AS length FROM down WHERE hops <= 5 GROUP BY src) a JOIN flow f ON f.id = a.src JOIN flow b ON b.id = a.cur")
def t_reach_slope(s, d):
    net = i.net(s, d)
    far = tree.kth_below(net, 5).join(net.select(F.col("id").alias("far"), F.col("z").alias("zf")), "far").join(net.select("id", "z"), "id")
    return rounded(far.select("id", F.when(F.col("length") == 0, F.lit(0.0)).otherwise((F.col("z") - F.col("zf")) / F.col("length")).alias("slope")))


@query(f"WITH {CELLS} SELECT id, CASE WHEN z >= 30 AND z < 60 THEN 0.07 WHEN z >= 10 AND z < 40 THEN 0.05 END AS by_bin, CASE WHEN z <= 25 THEN 0.03 WHEN z <= 45 THEN 0.06 END AS by_break FROM cells")
def t_elev_rule(s, d):
    z = F.col("z")
    return i.cells(s, d).select("id", terrain.by_bins(z, [(10, 40, 0.05), (30, 60, 0.07)]).alias("by_bin"), terrain.by_breaks(z, [(25, 0.03), (45, 0.06)]).alias("by_break"))


@query(f"WITH {CELLS}, v AS (SELECT id, CASE WHEN z <= 45 THEN z / 1000 END AS n FROM cells) SELECT id, {R('coalesce(n, avg(n) OVER ()) AS n')} FROM v")
def t_n_raster(s, d):
    return rounded(terrain.filled_with_mean(i.cells(s, d).select("id", F.when(F.col("z") <= 45, F.col("z") / 1000).alias("n")), "n"))


@query(f"WITH {CELLS} SELECT id, {R('5 + x * 0.1 AS lon')}, least(CAST(floor((5 + x * 0.1 + 180) / 6) AS INT) + 1, 60) AS zone FROM cells")
def t_latlon(s, d):
    return rounded(i.cells(s, d).select("id", (5 + F.col("x") * 0.1).alias("lon"), terrain.utm_zone(5 + F.col("x") * 0.1).alias("zone")))


@query(f"WITH RECURSIVE {DOWN} SELECT src AS id, {R('max(f.z + 0.02 * length) AS z')} FROM down JOIN flow f ON f.id = down.cur GROUP BY src")
def t_minslope(s, d):
    return rounded(tree.path_max(i.net(s, d), "z", 0.02, "z"))


@query(f"WITH RECURSIVE {DOWN} SELECT f0.id, {R('CASE WHEN any_value(f0.c) % 7 = 3 THEN any_value(f0.z) ELSE max(f.z + 0.02 * length) END AS z')} FROM down JOIN flow f ON f.id = down.cur JOIN flow f0 ON f0.id = src GROUP BY f0.id")
def t_condition(s, d):
    """Carved to a least gradient, lakes left as they are."""
    net = i.net(s, d).withColumn("lake", F.col("c") % 7 == 3)
    return rounded(terrain.conditioned(net, "carve", 0.02))


def _pits(s, d):
    return i.cells(s, d).select("id", "r", "c", (F.col("z") - F.when(F.col("id") % 17 == 3, 6.0).otherwise(0.0)).alias("z"), F.floor(F.col("c") / 32).alias("basin"))


@query()
def t_fill(s, d):
    return rounded(kernels.fill(_pits(s, d)))


@query()
def t_leastcost(s, d):
    return kernels.least_cost_groups(_pits(s, d))


@query(f"WITH {NET} SELECT f.id, f.c + 0.5 AS x0, f.r + 0.5 AS y0, f.c + 0.5 + dc * CASE WHEN f.ds IS NULL THEN 0.5 ELSE 1 END AS x1, f.r + 0.5 + dr * CASE WHEN f.ds IS NULL THEN 0.5 ELSE 1 END AS y1 FROM flow f JOIN d8 USING (code)")
def t_segments(s, d):
    net, n = i.net(s, d).where("ds is not null"), i.side(s, d)
    half = lambda c: (c + F.lit(0.5))
    return net.select("id", half(F.col("c")).alias("x0"), half(F.col("r")).alias("y0"), half(F.col("ds") % n).alias("x1"), half(F.floor(F.col("ds") / n)).alias("y1"))


# ================================================================ rain
@query("SELECT CAST(0 AS BIGINT) AS gauge_id, time_s, round(rate * 1e6, 6) AS rate FROM (VALUES (0.0, 20.0 / 1000 / 3600), (7200 - 1e-6, 20.0 / 1000 / 3600), (7200.0, 0.0)) v(time_s, rate)")
def p_uniform(s, d):
    return rain.uniform(s, 20.0, 7200.0).select("gauge_id", "time_s", F.round(F.col("rate") * 1e6, 6).alias("rate"))


@query(f"WITH {RAIN} SELECT gauge_id, time_s, {R('rate * 1e6 AS rate')} FROM rates")
def p_rate(s, d):
    return i.rates(s, d).select("gauge_id", "time_s", F.round(F.col("rate") * 1e6, 6).alias("rate"))


@query(f"WITH {CELLS}, {GAUGES}, {NEAR} SELECT * FROM near")
def p_thiessen(s, d):
    return rain.thiessen(i.cells(s, d), i.gauges(s, d))


@query(f"WITH {CELLS}, {GAUGES}, t AS (SELECT cells.id, gauge_id, (cells.x - g.x) ** 2 + (cells.y - g.y) ** 2 AS d2 FROM cells, gauges g WHERE floor(cells.x / 300) BETWEEN floor(g.x / 300) - 1 AND floor(g.x / 300) + 1 AND floor(cells.y / 300) BETWEEN floor(g.y / 300) - 1 AND floor(g.y / 300) + 1) SELECT cells.id, arg_min(gauge_id, d2 + gauge_id * 1e-9) AS gauge_id FROM cells LEFT JOIN t USING (id) GROUP BY cells.id")
def p_thiessen_tiles(s, d):
    return rain.nearest_by_tiles(i.cells(s, d), i.gauges(s, d), 300.0)


_IDW = "raw AS (SELECT cells.id, gauge_id, CASE WHEN min(d2) OVER (PARTITION BY cells.id) = 0 THEN CAST(d2 = 0 AS DOUBLE) ELSE 1 / d2 END AS raw FROM (SELECT cells.id, gauge_id, (cells.x - g.x) ** 2 + (cells.y - g.y) ** 2 AS d2 FROM cells, gauges g) cells), idw AS (SELECT id, gauge_id, raw / sum(raw) OVER (PARTITION BY id) AS w FROM raw)"


@query(f"WITH {CELLS}, {GAUGES}, {_IDW} SELECT id, gauge_id, {R('w')} FROM idw")
def p_idw(s, d):
    return rounded(rain.idw(i.cells(s, d), i.gauges(s, d)))


@query(f"WITH {CELLS}, {GAUGES}, {NEAR} SELECT gauge_id AS zone, count(*) AS cells FROM near GROUP BY 1")
def p_zone(s, d):
    return rain.thiessen(i.cells(s, d), i.gauges(s, d)).groupBy(F.col("gauge_id").alias("zone")).agg(F.count(F.lit(1)).alias("cells"))


@query(f"WITH {CELLS}, {GAUGES} SELECT gauge_id FROM gauges g JOIN cells ON cells.c = floor(g.x / {SIZE}) AND cells.r = floor(g.y / {SIZE}) AND cells.c % 2 = 0")
def p_drop_out(s, d):
    return rain.inside(i.gauges(s, d), i.cells(s, d).where("c % 2 = 0"), SIZE).select("gauge_id")


def _times(s, d):
    return s.range(10).select(F.col("id").alias("gauge_id"), F.explode(F.sequence(F.lit(-3), F.lit(130))).alias("k")).select("gauge_id", (F.col("k") * 20_000.0).alias("t"))


_TIMES = "times AS (SELECT g.range AS gauge_id, (k.range - 3) * 20000.0 AS t FROM range(10) g, range(134) k)"
_KNOTS = """k AS (SELECT gauge_id, time_s AS t0, rate AS v0, lead(time_s) OVER w AS t1, lead(rate) OVER w AS v1, lag(time_s) OVER w AS tb, lag(rate) OVER w AS vb FROM rates WINDOW w AS (PARTITION BY gauge_id ORDER BY time_s)),
    f AS (SELECT gauge_id, min(t0) AS ft, arg_min(v0, t0) AS fv, arg_min(t1, t0) AS st, arg_min(v1, t0) AS sv FROM k GROUP BY 1),
    m AS (SELECT x.gauge_id, x.t, k.*EXCLUDE (gauge_id), f.*EXCLUDE (gauge_id) FROM times x JOIN f ON f.gauge_id = x.gauge_id LEFT JOIN k ON k.gauge_id = x.gauge_id AND k.t0 <= x.t AND (k.t1 IS NULL OR x.t < k.t1))"""
_INSIDE = "v0 + (v1 - v0) * (t - t0) / (t1 - t0)"


def _interpolated(s, d, policy):
    return rain.interpolate(i.rates(s, d), _times(s, d), policy).select("gauge_id", "t", F.round(F.col("value") * 1e6, 5).alias("value"))


@query(f"WITH {RAIN}, {_TIMES}, {_KNOTS} SELECT gauge_id, t, round(1e6 * CASE WHEN t0 IS NULL THEN 0 WHEN t1 IS NULL THEN CASE WHEN t = t0 THEN v0 ELSE 0 END ELSE {_INSIDE} END, 5) AS value FROM m")
def p_interp(s, d):
    return _interpolated(s, d, "zero")


@query(f"WITH {RAIN}, {_TIMES}, {_KNOTS} SELECT gauge_id, t, round(1e6 * CASE WHEN t0 IS NULL THEN fv WHEN t1 IS NULL THEN v0 ELSE {_INSIDE} END, 5) AS value FROM m")
def ts_interp_hold(s, d):
    return _interpolated(s, d, "hold")


@query(f"WITH {RAIN}, {_TIMES}, {_KNOTS} SELECT gauge_id, t, round(1e6 * CASE WHEN t0 IS NULL THEN fv + (sv - fv) * (t - ft) / (st - ft) WHEN t1 IS NULL THEN v0 + (v0 - vb) * (t - t0) / (t0 - tb) ELSE {_INSIDE} END, 5) AS value FROM m")
def r_raster(s, d):
    return _interpolated(s, d, "extrapolate")


@query(f"WITH {CELLS}, {GAUGES}, {_IDW}, {RAIN} SELECT id, time_s AS t, {R('sum(w * rate) * 1e6 AS rate')} FROM idw JOIN rates USING (gauge_id) GROUP BY ALL")
def p_field(s, d):
    rates = i.rates(s, d).select("gauge_id", F.col("time_s").alias("t"), F.col("rate").alias("value"))
    return rain.idw_field(i.cells(s, d), i.gauges(s, d), rates).select("id", "t", F.round(F.col("rate") * 1e6, 6).alias("rate"))


@query(f"WITH {CELLS} SELECT r, c, {R('CASE WHEN id % 3 = 0 THEN z END AS z')} FROM cells")
def p_field2d(s, d):
    grid = i.cells(s, d)
    return rounded(grid.select("r", "c").join(grid.where("id % 3 = 0").select("r", "c", "z"), ["r", "c"], "left"))


@query(f"WITH {RAIN} SELECT time_s, max(rate) > 2e-6 AS raining, (SELECT max(time_s) FROM rates) AS last_time FROM rates GROUP BY time_s")
def p_israining(s, d):
    rates = i.rates(s, d)
    end = F.broadcast(rates.agg(F.max("time_s").alias("last_time")))  # a single row
    return rates.groupBy("time_s").agg((F.max("rate") > 2e-6).alias("raining")).join(end)


@query(f"WITH {CELLS} SELECT id, {R('least(greatest((45 - z) / 20, 0), 1) AS fraction')}, CASE WHEN z <= 30 THEN 1.0 ELSE 0.0 END AS step FROM cells")
def p_snow(s, d):
    return rounded(i.cells(s, d).select("id", rain.rain_fraction(F.col("z"), 25, 45).alias("fraction"), rain.rain_fraction(F.col("z"), 30, 30).alias("step")))


@query(f"WITH {RAIN} SELECT g.range AS gauge_id, CAST(k.range * 21600 AS DOUBLE) AS time_s, {R('greatest(coalesce(depth_mm, 0), 0) AS depth_mm')} FROM range(10) g, range(131) k LEFT JOIN (SELECT * FROM series WHERE time_s // 21600 % 5 <> 2) x ON x.gauge_id = g.range AND x.time_s = k.range * 21600")
def ts_regularise(s, d):
    holed = i.series(s, d).where("floor(time_s / 21600) % 5 <> 2")
    return rounded(rain.regular(holed, 21_600, 0, 130 * 21_600))


@query("""WITH p AS (SELECT s_suppkey AS request, round(45 + s_suppkey % 7 * 0.1 + s_suppkey * 1e-6, 9) AS lat, round(9 + s_suppkey % 5 * 0.1, 9) AS lon, CASE WHEN s_suppkey % 6 <> 1 THEN s_acctbal END AS depth FROM supplier),
    k AS (SELECT * FROM p WHERE depth IS NOT NULL QUALIFY row_number() OVER (PARTITION BY round(lat, 3), round(lon, 3) ORDER BY request) = 1)
    SELECT request, row_number() OVER (ORDER BY lat DESC, lon) AS gauge_id FROM k""")
def ts_merge(s, d):
    k = F.col("s_suppkey")
    points = i.table(s, d, "supplier").select(k.alias("request"), F.round(45 + k % 7 * 0.1 + k * 1e-6, 9).alias("lat"), F.round(9 + k % 5 * 0.1, 9).alias("lon"), F.when(k % 6 != 1, F.col("s_acctbal")).alias("depth_mm"))
    return rain.merged_points(points).select("request", F.col("gauge_id").cast("bigint").alias("gauge_id"))


@query("SELECT o_orderkey AS id, CASE WHEN date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02') > 91 THEN 'archive' ELSE 'forecast' END AS source FROM orders")
def ts_source(s, d):
    return i.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.datediff(F.lit("1998-08-02").cast("date"), F.to_date("o_orderdate")) > 91, "archive").otherwise("forecast").alias("source"))


# ================================================================ runoff
@query(f"WITH {RAIN} SELECT gauge_id, time_s, {R('rate * 1e6 AS none', 'rate * 1e6 * least(greatest(gauge_id * 0.2 - 0.2, 0), 1) AS coef')} FROM rates")
def r_coef(s, d):
    r = F.col("rate") * 1e6
    return rounded(i.rates(s, d).select("gauge_id", "time_s", runoff.MODES["none"](r).alias("none"), runoff.MODES["coefficient"](r, F.col("gauge_id") * 0.2 - 0.2).alias("coef")))


@query("SELECT o_orderkey AS id, round(CASE WHEN o_orderkey % 3 = 0 THEN cn / (2.281 - 0.01281 * cn) WHEN o_orderkey % 3 = 2 THEN cn / (0.427 + 0.00573 * cn) ELSE cn END, 6) AS cn FROM (SELECT o_orderkey, 40 + o_orderkey % 60 AS cn FROM orders)")
def r_amc(s, d):
    k = F.col("o_orderkey")
    return i.table(s, d, "orders").select(k.alias("id"), F.round(runoff.moisture((40 + k % 60).cast("double"), k % 3 + 1), 6).alias("cn"))


def _cn_series(s, d):
    return i.series(s, d).select(F.col("gauge_id").alias("id"), F.col("time_s").alias("t"), "depth_mm", (60.0 + F.col("gauge_id") * 4).alias("cn"))


_SCS = "o AS (SELECT *, greatest(pe - coalesce(lag(pe) OVER (PARTITION BY id ORDER BY t), 0), 0) AS own FROM e), x AS (SELECT *, coalesce(lag(own) OVER (PARTITION BY id ORDER BY t), 0) AS mm FROM o)"


@query(f"""WITH {RAIN}, a AS (SELECT gauge_id AS id, time_s AS t, 25400 / (60.0 + gauge_id * 4) - 254 AS s, sum(depth_mm) OVER (PARTITION BY gauge_id ORDER BY time_s ROWS UNBOUNDED PRECEDING) AS p FROM series),
    e AS (SELECT *, CASE WHEN p > 0.2 * s THEN (p - 0.2 * s) ** 2 / (p + 0.8 * s) ELSE 0 END AS pe FROM a), {_SCS} SELECT id, t, {R('mm AS excess_mm')} FROM x""")
def r_scs(s, d):
    return rounded(runoff.curve_number(_cn_series(s, d)))


def _soil(s, d):
    rains = i.series(s, d).groupBy(F.col("gauge_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("time_s", "depth_mm"))).alias("x"))
    return rains.select("id", F.transform("x", lambda x: x["depth_mm"] / 1000 / 3600).alias("rain"), (F.lit(2e-7) * (F.col("id") + 1)).alias("ksat"), F.lit(0.15).alias("psi"), F.lit(0.2).alias("dtheta"))


_GA = f"""WITH RECURSIVE {RAIN}, x AS (SELECT gauge_id AS id, depth_mm / 1000 / 3600 AS rain, row_number() OVER (PARTITION BY gauge_id ORDER BY time_s) AS k, 2e-7 * (gauge_id + 1) AS ksat FROM series)"""


@query(_GA + f""", g AS (SELECT id, CAST(0 AS BIGINT) AS k, CAST(0 AS DOUBLE) AS f, CAST(0 AS DOUBLE) AS e FROM x GROUP BY id UNION ALL
    SELECT g.id, x.k, f + least(rain, ksat * (1 + 0.03 / greatest(f, 1e-9))) * 3600, e + (rain - least(rain, ksat * (1 + 0.03 / greatest(f, 1e-9)))) * 3600 FROM g JOIN x ON x.id = g.id AND x.k = g.k + 1)
    SELECT id, {R('max(f) AS infiltrated', 'max(e) AS excess')} FROM g GROUP BY id""")
def r_ga(s, d):
    return rounded(runoff.green_ampt(_soil(s, d), 3600.0))


@query(_GA + """, y AS (SELECT *, sqrt(greatest(ksat * 1000 * 3600 / 25.4, 1e-12)) AS root FROM x),
    p AS (SELECT *, 4 * root * 0.0254 AS upper, root / 75 / 3600 * 3600 * 0.2 * 4 * root * 0.0254 AS loss, 4.5 / root * 3600 AS dry_time, 0.2 * 4 * root * 0.0254 AS holds FROM y),
    g AS (SELECT id, CAST(0 AS BIGINT) AS k, CAST(0 AS DOUBLE) AS f, CAST(0 AS DOUBLE) AS u, CAST(0 AS DOUBLE) AS t, CAST(0.2 AS DOUBLE) AS dt, CAST(0 AS DOUBLE) AS e FROM p GROUP BY id UNION ALL
    SELECT id, k, CASE kind WHEN 'wet' THEN if(clock <= 0, 0, f + soak) WHEN 'drains' THEN if(clock <= 0, 0, greatest(f - loss, 0)) WHEN 'empties' THEN 0 ELSE f END,
        CASE kind WHEN 'wet' THEN least(u + soak, holds) WHEN 'drains' THEN u - loss ELSE 0 END, clock,
        CASE WHEN kind = 'empties' THEN 0.2 WHEN kind = 'wet' AND clock <= 0 THEN (holds - least(u + soak, holds)) / upper WHEN kind = 'drains' AND clock <= 0 THEN (holds - u + loss) / upper ELSE dt END,
        CASE kind WHEN 'wet' THEN e + rain * 3600 - soak ELSE e END FROM (
        SELECT g.*EXCLUDE (k), p.*EXCLUDE (id), CASE WHEN rain > 0 THEN 'wet' WHEN u <= 0 THEN 'idle' WHEN u <= loss THEN 'empties' ELSE 'drains' END AS kind,
            least(rain, ksat * (1 + 0.15 * dt / greatest(f, 1e-9))) * 3600 AS soak, CASE WHEN rain > ksat THEN dry_time ELSE t - 3600 END AS clock FROM g JOIN p ON p.id = g.id AND p.k = g.k + 1))
    SELECT id, round(arg_max(f, k), 6) AS infiltrated, round(arg_max(u, k), 6) AS zone, round(arg_max(dt, k), 6) AS deficit, round(arg_max(e, k), 6) AS excess FROM g GROUP BY id""")
def r_ga_recover(s, d):
    return rounded(runoff.green_ampt_recovering(_soil(s, d), 3600.0))


@query(f"WITH {CELLS}, v AS (SELECT id, CASE WHEN id % 9 <> 0 THEN z END AS v FROM cells) SELECT id, {R('coalesce(v, (SELECT median(v) FROM v)) AS ksat', 'least(greatest(coalesce(v, (SELECT median(v) FROM v)) / 50, 0), 1) AS dtheta')} FROM v")
def r_params(s, d):
    v = i.cells(s, d).select("id", F.when(F.col("id") % 9 != 0, F.col("z")).alias("v"))
    middle = F.broadcast(v.agg(F.median("v").alias("m")))  # a single row
    k = F.coalesce("v", "m")
    return rounded(v.join(middle).select("id", k.alias("ksat"), F.least(F.greatest(k / 50, F.lit(0.0)), F.lit(1.0)).alias("dtheta")))


_TEXTURE = """CASE WHEN clay >= 40 AND sand <= 45 AND silt < 40 THEN 'clay' WHEN clay >= 40 AND silt >= 40 THEN 'silty_clay' WHEN clay >= 35 AND sand >= 45 THEN 'sandy_clay'
    WHEN clay >= 27 AND clay < 40 AND sand > 20 AND sand <= 45 THEN 'clay_loam' WHEN clay >= 27 AND clay < 40 AND sand <= 20 THEN 'silty_clay_loam' WHEN clay >= 20 AND clay < 35 AND silt < 28 AND sand > 45 THEN 'sandy_clay_loam'
    WHEN clay >= 7 AND clay < 27 AND silt >= 28 AND silt < 50 AND sand <= 52 THEN 'loam' WHEN silt >= 50 AND (clay >= 12 AND clay < 27 OR silt < 80 AND clay < 12) THEN 'silt_loam' WHEN silt >= 80 AND clay < 12 THEN 'silt'
    WHEN clay >= 7 AND clay < 20 AND sand > 52 AND silt + 2 * clay >= 30 OR clay < 7 AND silt < 50 AND silt + 2 * clay >= 30 THEN 'sandy_loam' WHEN silt + 1.5 * clay >= 15 AND silt + 1.5 * clay < 30 THEN 'loamy_sand' WHEN silt + 1.5 * clay < 15 THEN 'sand' ELSE 'loam' END"""


@query(f"SELECT id, {_TEXTURE} AS class FROM (SELECT o_orderkey AS id, o_orderkey * 7 % 101 AS sand, (100 - o_orderkey * 7 % 101) * (o_orderkey % 11) / 10.0 AS clay, 100 - o_orderkey * 7 % 101 - (100 - o_orderkey * 7 % 101) * (o_orderkey % 11) / 10.0 AS silt FROM orders)")
def r_texture(s, d):
    k = F.col("o_orderkey")
    sand = (k * 7 % 101).cast("double")
    return i.table(s, d, "orders").select(k.alias("id"), sand.alias("sand"), ((100 - sand) * (k % 11) / 10).alias("clay")).transform(runoff.texture).select("id", "class")


@query("SELECT * FROM (VALUES ('sand', 0.0495), ('loamy_sand', 0.0613), ('sandy_loam', 0.1101), ('loam', 0.0889), ('silt_loam', 0.1668), ('silt', 0.1668), ('sandy_clay_loam', 0.2185), ('clay_loam', 0.2088), ('silty_clay_loam', 0.273), ('sandy_clay', 0.239), ('silty_clay', 0.2922), ('clay', 0.3163)) v(class, psi_m)")
def r_psi(s, d):
    names = s.range(1).select(F.explode(F.array(*map(F.lit, runoff.SUCTION_CM))).alias("class"))
    return names.select("class", F.round(runoff.suction_m(F.col("class")), 6).alias("psi_m"))


@query(f"WITH {LAND} SELECT o_orderkey AS id, CASE WHEN o_orderkey % 12 = 11 THEN 0 ELSE CAST(impervious_fraction AS DOUBLE) END AS impervious FROM orders LEFT JOIN land ON class_code = (o_orderkey % 12) * 10")
def r_imperv(s, d):
    k = F.col("o_orderkey")
    coded = i.table(s, d, "orders").select(k.alias("id"), (k % 12 * 10).cast("int").alias("class_code"))
    joined = coded.join(F.broadcast(tables.lookup(s)), "class_code", "left")
    return joined.select("id", F.when(F.col("id") % 12 == 11, 0.0).otherwise(F.col("impervious_fraction")).alias("impervious"))


@query("SELECT CAST(range AS BIGINT) AS zone, round(a0, 4) AS a0, round(a0 / (a0 - 900) * ln(0.05 / (0.2 + range * 0.01)), 6) AS head FROM (SELECT range, 900.0 * 1000 * (range + 1) / (1 - ln(0.001 / 2.0)) AS a0 FROM range(10))")
def r_vsa_init(s, d):
    outlet = (F.col("id") + 1) * 900_000.0
    a, h = runoff.source_area_start(outlet, F.lit(900.0), F.lit(0.001), F.lit(2.0), F.lit(0.05), 0.2 + F.col("id") * 0.01)
    return s.range(10).select(F.col("id").alias("zone"), F.round(a, 4).alias("a0"), F.round(h, 6).alias("head"))


def _zones(s, d):
    outlet = (F.col("zone") + 1) * 900_000.0
    a, h = runoff.source_area_start(outlet, F.lit(900.0), F.lit(0.001), F.lit(2.0), F.lit(0.05), F.lit(0.4))
    inflow = i.rates(s, d).groupBy(F.col("gauge_id").alias("zone")).agg(F.array_sort(F.collect_list(F.struct("time_s", "rate"))).alias("x"))
    return inflow.select("zone", F.transform("x", lambda x: x["rate"]).alias("inflow"), a.alias("a0"), h.alias("head"), outlet.alias("outlet_area"), F.lit(900.0).alias("cell_area"), F.lit(30.0).alias("size"), F.lit(1e-5).alias("ksat"), F.lit(0.01).alias("slope"), F.lit(0.3).alias("phi"), F.lit(0.4).alias("sd"), F.lit(0.05).alias("sd_min"))


@query(f"""WITH RECURSIVE {RAIN}, x AS (SELECT gauge_id AS zone, rate, row_number() OVER (PARTITION BY gauge_id ORDER BY time_s) AS k FROM rates),
    p AS (SELECT range AS zone, 900000.0 * (range + 1) AS ao, 900000.0 * (range + 1) / (1 - ln(0.001 / 2.0)) AS a0 FROM range(10)), q AS (SELECT *, a0 / (a0 - 900) * ln(0.05 / 0.4) AS head FROM p),
    g AS (SELECT zone, CAST(0 AS BIGINT) AS k, CAST(0 AS DOUBLE) AS z FROM q UNION ALL SELECT g.zone, x.k, greatest(z + (rate * 900 - 1e-5 * 0.01 * z * 30) * 21600 / (900 * 0.3), 0) FROM g JOIN x ON x.zone = g.zone AND x.k = g.k + 1),
    l AS (SELECT zone, arg_max(z, k) AS z FROM g GROUP BY zone)
    SELECT zone, {R('z AS level')}, {R('least(greatest(head * 900 / (head - ln(0.05 / greatest(0.4 - z, 0.05))), 900), ao) AS area', digits=3)} FROM l JOIN q USING (zone)""")
def r_vsa_step(s, d):
    out = runoff.source_area(_zones(s, d), 21_600.0)
    return out.select("zone", F.round("level", 6).alias("level"), F.round("area", 3).alias("area"))


@query(f"WITH RECURSIVE {FACC}, {GAUGES}, {NEAR} SELECT near.gauge_id AS zone, count(*) FILTER (WHERE facc * 900.0 > 20000 * (gauge_id + 1)) AS wet_cells, count(*) AS cells FROM near JOIN net USING (id) GROUP BY 1")
def r_opm(s, d):
    cells = i.net(s, d).join(rain.thiessen(i.cells(s, d), i.gauges(s, d)), "id").select("id", F.col("gauge_id").alias("zone"), (F.col("facc") * 900.0).alias("upslope"))
    areas = s.range(10).select(F.col("id").alias("zone"), ((F.col("id") + 1) * 20_000.0).alias("area"))
    return runoff.saturated(cells, areas).groupBy("zone").agg(F.count_if("wet").alias("wet_cells"), F.count(F.lit(1)).alias("cells"))


@query(f"WITH RECURSIVE {FACC}, {GAUGES}, {NEAR} SELECT near.gauge_id AS zone, net.id AS divide FROM near JOIN net USING (id) QUALIFY row_number() OVER (PARTITION BY near.gauge_id ORDER BY facc, z DESC, net.id) = 1")
def r_divide(s, d):
    return runoff.divides(i.net(s, d).join(rain.thiessen(i.cells(s, d), i.gauges(s, d)), "id").withColumnRenamed("gauge_id", "zone"))


@query(_GA + f""", g AS (SELECT id, CAST(0 AS BIGINT) AS k, CAST(0 AS DOUBLE) AS level, CAST(0 AS DOUBLE) AS f, CAST(0 AS DOUBLE) AS dunne, CAST(0 AS DOUBLE) AS horton FROM x GROUP BY id UNION ALL
    SELECT id, k, up, if(wet, f, f + into_), if(wet, dunne + rain * 3600, dunne), if(wet, horton, horton + rain * 3600 - into_) FROM (
        SELECT g.id, x.k, g.f, g.dunne, g.horton, rain, least(rain, ksat * (1 + 0.03 / greatest(f, 1e-9))) * 3600 AS into_, level + rain * 3600 * 0.4 / 0.3 AS up, level + rain * 3600 * 0.4 / 0.3 > 0.12 AS wet FROM g JOIN x ON x.id = g.id AND x.k = g.k + 1))
    SELECT id, {R('max(level) AS level', 'max(f) AS infiltrated', 'max(dunne) AS dunne', 'max(horton) AS horton')} FROM g GROUP BY id""")
def r_order(s, d):
    """Each step fills the store first; soil that is full by then takes up nothing."""
    return rounded(runoff.saturation_first(_soil(s, d).withColumn("threshold", F.lit(0.12)), 3600.0, 0.4, 0.3))


@query(f"""WITH {CELLS}, {GAUGES}, {NEAR}, z AS (SELECT gauge_id AS zone, avg(z) / 100 AS sd, 2e-7 * (gauge_id + 1) AS ksat FROM near JOIN cells USING (id) GROUP BY 1, gauge_id)
    SELECT zone, {R('CASE WHEN zone % 2 = 0 THEN 0.3 ELSE greatest(sd, 0.05) END AS sd', '0.3 AS phi')}, CASE WHEN zone % 2 = 0 THEN 'manual' ELSE 'derived' END AS source, round(CASE WHEN zone % 3 = 0 THEN 1e-6 ELSE ksat END * 1e6, 6) AS ksat_um_s FROM z""")
def r_soil(s, d):
    """Deficit, porosity and conductivity by zone: given by hand, or derived where nothing is given."""
    z = i.cells(s, d).join(rain.thiessen(i.cells(s, d), i.gauges(s, d)), "id").groupBy(F.col("gauge_id").alias("zone")).agg((F.avg("z") / 100).alias("sd"))
    derived = z.withColumns({"ksat": F.lit(2e-7) * (F.col("zone") + 1), "phi": F.lit(None).cast("double")})
    manual = s.range(10).select(F.col("id").alias("zone"), F.when(F.col("id") % 2 == 0, 0.3).alias("sd"), F.lit(None).cast("double").alias("phi"), F.when(F.col("id") % 3 == 0, 1e-6).alias("ksat"))
    out = runoff.resolved(manual, derived, {"sd": 0.2, "phi": 0.3, "ksat": 1e-6}, 0.05)
    return out.select("zone", F.round("sd", 6).alias("sd"), F.round("phi", 6).alias("phi"), "source", F.round(F.col("ksat") * 1e6, 6).alias("ksat_um_s"))


@query(f"WITH {CELLS}, {GAUGES}, {NEAR} SELECT gauge_id AS zone, {R('greatest(avg(z) / 100, 0.05) AS mean', 'greatest(max(z) / 100, 0.05) AS most')} FROM near JOIN cells USING (id) GROUP BY 1")
def r_zone_sd(s, d):
    z = i.cells(s, d).join(rain.thiessen(i.cells(s, d), i.gauges(s, d)), "id").groupBy(F.col("gauge_id").alias("zone"))
    return rounded(z.agg(F.greatest(F.avg("z") / 100, F.lit(0.05)).alias("mean"), F.greatest(F.max("z") / 100, F.lit(0.05)).alias("most")))


@query("SELECT o_orderkey AS id, round(r * i, 6) AS imperv, round(CASE WHEN w THEN r * (1 - i) ELSE 0 END, 6) AS dunne, round(CASE WHEN w THEN 0 ELSE r * (1 - i) * e END, 6) AS horton FROM (SELECT o_orderkey, o_totalprice / 1000 AS r, o_orderkey % 10 / 10.0 AS i, o_orderkey % 4 = 0 AS w, o_orderkey % 7 / 7.0 AS e FROM orders)")
def r_combine(s, d):
    k = F.col("o_orderkey")
    parts = runoff.combined(F.col("o_totalprice") / 1000, k % 10 / 10, k % 4 == 0, k % 7 / 7)
    return rounded(i.table(s, d, "orders").select(k.alias("id"), *[c.alias(n) for n, c in parts.items()]))


@query("SELECT id, round(CASE WHEN v < 0 THEN 0.3 ELSE least(greatest(least(greatest(1.33 * v - 0.049, 0), 1) * 0.2 + 0.1, 0.1), 0.3) END, 6) AS theta, round(greatest(0.45 - CASE WHEN v < 0 THEN 0.3 ELSE least(greatest(least(greatest(1.33 * v - 0.049, 0), 1) * 0.2 + 0.1, 0.1), 0.3) END, 0) * 1.5, 6) AS deficit FROM (SELECT o_orderkey AS id, o_orderkey % 121 / 100.0 - 0.2 AS v FROM orders)")
def r_serves(s, d):
    k = F.col("o_orderkey")
    parts = runoff.soil_water(k % 121 / 100 - 0.2, F.lit(0.3), F.lit(0.1), F.lit(0.45), F.lit(1.5))
    return rounded(i.table(s, d, "orders").select(k.alias("id"), *[c.alias(n) for n, c in parts.items()]))


@query("SELECT o_custkey AS pixel, round(median(o_totalprice), 6) AS composite, arg_min(o_orderkey, abs(date_diff('day', CAST(o_orderdate AS DATE), DATE '1995-06-15')) * 1000000 + o_orderkey) AS nearest FROM orders WHERE (o_orderkey & 24) = 0 GROUP BY 1")
def r_ndvi(s, d):
    clear = i.table(s, d, "orders").where(F.col("o_orderkey").bitwiseAND(24) == 0)
    gap = F.abs(F.datediff(F.to_date("o_orderdate"), F.lit("1995-06-15").cast("date")))
    return rounded(runoff.nearest_scene(clear.select(F.col("o_custkey").alias("pixel"), F.col("o_totalprice").alias("value"), gap.alias("gap"), F.col("o_orderkey").alias("scene"))))


@query("SELECT o_custkey AS id, round(sum(w * v) / sum(w), 6) AS mean, round(sum(w) / sum(w / greatest(v, 1e-6)), 6) AS harmonic FROM (SELECT o_custkey, 1 + o_orderkey % 5 AS w, o_totalprice AS v FROM orders) GROUP BY 1")
def r_depthavg(s, d):
    return rounded(runoff.layer_means(i.table(s, d, "orders").select(F.col("o_custkey").alias("id"), (1 + F.col("o_orderkey") % 5).alias("w"), F.col("o_totalprice").alias("v"))))


# ================================================================ surface and channels
@query(f"WITH RECURSIVE {FACC}, {LAND} SELECT id, CAST(CASE WHEN facc > 50 THEN 0.035 ELSE coalesce(mannings_n, 0.05) END AS DOUBLE) AS n, CAST(coalesce(root_zone_depth_m, 1) AS DOUBLE) AS root FROM net LEFT JOIN land ON class_code = (id % 11) * 10")
def s_n(s, d):
    met = i.net(s, d).withColumn("class_code", (F.col("id") % 11 * 10).cast("int")).join(F.broadcast(tables.lookup(s)), "class_code", "left")
    return met.select("id", F.when(F.col("facc") > 50, 0.035).otherwise(F.coalesce("mannings_n", F.lit(0.05))).alias("n"), F.coalesce("root_zone_depth_m", F.lit(1.0)).alias("root"))


@query(f"WITH {LAND} SELECT class_name, count(*) AS cells FROM orders JOIN land ON class_code = (o_orderkey % 11) * 10 GROUP BY 1")
def s_lookup(s, d):
    coded = i.table(s, d, "orders").select((F.col("o_orderkey") % 11 * 10).cast("int").alias("class_code"))
    return coded.join(F.broadcast(tables.lookup(s)), "class_code").groupBy("class_name").agg(F.count(F.lit(1)).alias("cells"))


@query(f"WITH RECURSIVE {FACC} SELECT id FROM net WHERE facc > least(500, (SELECT 0.1 * max(facc) FROM net))")
def s_chan(s, d):
    net = i.net(s, d)
    most = F.broadcast(net.agg((F.max("facc") * 0.1).alias("m")))  # a single row
    return net.join(most).where(F.col("facc") > F.least(F.lit(500.0), F.col("m"))).select("id")


@query(f"WITH RECURSIVE {FACC} SELECT id, {R('2.70 * pow(greatest(facc * 0.0009, 1e-6), 0.352) AS width', '0.30 * pow(greatest(facc * 0.0009, 1e-6), 0.213) AS depth')} FROM net")
def s_hg(s, d):
    w, h = hy.geometry(F.col("facc") * 0.0009, "usa")
    return rounded(i.net(s, d).select("id", w.alias("width"), h.alias("depth")))


@query()
def s_discharge_geom(s, d):
    q = F.col("facc") * 0.001
    width = F.least(7.2 * F.sqrt(q), F.lit(SIZE))
    return rounded(i.net(s, d).select("id", width.alias("width"), F.greatest(hy.normal_depth(q, F.lit(0.01), F.lit(0.035), width), F.lit(0.1)).alias("depth")))


@query(f"WITH RECURSIVE {FACC}, rv AS (SELECT * FROM net WHERE facc > 100) SELECT cur AS id, {R('min(a.z - 0.001 * length) AS bed')} FROM down JOIN rv a ON a.id = src JOIN rv b ON b.id = cur GROUP BY cur")
def s_monotone(s, d):
    return rounded(flood.river_beds(i.net(s, d).withColumn("river", F.col("facc") > 100), 0.001))


@query(f"WITH RECURSIVE {FACC}, low AS (SELECT cur AS id, count(*) FILTER (WHERE f.z < 30) AS b FROM down JOIN flow f ON f.id = src GROUP BY cur) SELECT id, {R('0.5 * pow(facc * 0.0009, 0.75) * exp(-b * 0.0009) + greatest(0.1, sqrt(b * 0.0009)) AS q')} FROM net JOIN low USING (id)")
def s_qbf(s, d):
    net = i.net(s, d)
    below = tree.accumulate(net.withColumn("b", F.when(F.col("z") < 30, 1).otherwise(0)), "b", "below")
    met = net.join(below, "id")
    q = formula.compiled("0.5*A^0.75*exp(-A_below(30)) + max(0.1, sqrt(A_below(30)))", {"A": F.col("facc") * 0.0009}, {"A_below": lambda z: F.col("below") * 0.0009})
    return rounded(met.select("id", q.alias("q")))


@query("SELECT o_custkey % 50 AS site, round(median(m), 4) AS q2 FROM (SELECT o_custkey, year(o_orderdate) AS y, max(o_totalprice) AS m FROM (SELECT o_custkey % 50 AS o_custkey, o_orderdate, o_totalprice FROM orders) GROUP BY ALL) GROUP BY 1 HAVING count(*) >= 3")
def s_qbf_peaks(s, d):
    years = i.table(s, d, "orders").groupBy((F.col("o_custkey") % 50).alias("site"), F.year("o_orderdate").alias("y")).agg(F.max("o_totalprice").alias("m"))
    return years.groupBy("site").agg(F.round(F.median("m"), 4).alias("q2"), F.count(F.lit(1)).alias("n")).where("n >= 3").drop("n")


@query("""WITH g AS (SELECT w.range AS i, h.range AS j, 2 * pow(1000.0, w.range / 399.0) AS w, h.range * 0.05 AS h0 FROM range(400) w, range(21) h), o AS (SELECT range AS k, 0.5 + range * 0.2 AS h, 30 * pow(0.5 + range * 0.2 - 0.25, 5.0 / 3) AS q FROM range(15))
    SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j FROM (SELECT i, j, sqrt(avg((w * pow(greatest(h - h0, 0), 5.0 / 3) - q) ** 2)) AS e FROM g, o GROUP BY ALL ORDER BY e, i, j LIMIT 1)""")
def s_fit_rating(s, d):
    grid = s.range(400).select(F.col("id").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(20))).alias("j"))
    seen = F.broadcast(s.range(15).select((0.5 + F.col("id") * 0.2).alias("h")).select("h", (30 * F.pow(F.col("h") - 0.25, F.lit(5 / 3))).alias("q")))
    fit = 2 * F.pow(F.lit(1000.0), F.col("i") / 399) * F.pow(F.greatest(F.col("h") - F.col("j") * 0.05, F.lit(0.0)), F.lit(5 / 3))
    errors = grid.join(seen).groupBy("i", "j").agg(F.sqrt(F.avg(F.pow(fit - F.col("q"), F.lit(2)))).alias("e"))
    return errors.agg(F.min(F.struct("e", "i", "j")).alias("m")).select("m.i", "m.j")


@query(f"WITH RECURSIVE {FACC} SELECT id, {R('least(2.70 * pow(greatest(facc * 0.0009, 1e-6), 0.352) * coalesce(dist, 30), 900) AS store')} FROM net WHERE facc > 100")
def s_chan_geom(s, d):
    w, _ = hy.geometry(F.col("facc") * 0.0009, "usa")
    return rounded(i.net(s, d).where("facc > 100").select("id", F.least(w * F.coalesce("dist", F.lit(SIZE)), F.lit(900.0)).alias("store")))


@query("SELECT g, k AS ord, last_value(v IGNORE NULLS) OVER (PARTITION BY g ORDER BY k) AS bank FROM (SELECT s_nationkey AS g, s_suppkey AS k, CASE WHEN s_suppkey % 4 = 0 THEN round(s_acctbal, 2) END AS v FROM supplier)")
def s_bank(s, d):
    given = i.table(s, d, "supplier").select(F.col("s_nationkey").alias("g"), F.col("s_suppkey").alias("ord"), F.when(F.col("s_suppkey") % 4 == 0, F.round("s_acctbal", 2)).alias("v"))
    return given.select("g", "ord", F.last("v", ignorenulls=True).over(W.partitionBy("g").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)).alias("bank"))


@query(f"WITH RECURSIVE {FACC} SELECT a.id, a.facc - coalesce(sum(b.facc), 0)::BIGINT AS lateral_cells FROM net a LEFT JOIN net b ON b.ds = a.id AND b.facc > 100 WHERE a.facc > 100 GROUP BY a.id, a.facc")
def s_baseflow(s, d):
    chan = i.net(s, d).where("facc > 100")
    above = chan.where("ds is not null").groupBy(F.col("ds").alias("id")).agg(F.sum("facc").alias("up"))
    return chan.join(above, "id", "left").select("id", (F.col("facc") - F.coalesce("up", F.lit(0))).alias("lateral_cells"))


# ================================================================ hydraulics
_H = "SELECT o_orderkey AS id, 0.01 + o_orderkey % 200 / 100.0 AS h, 0.001 + o_orderkey % 30 / 1000.0 AS s, 0.02 + o_orderkey % 9 / 100.0 AS n, 2 + o_orderkey % 10 AS w FROM orders"


def _hydro(s, d):
    k = F.col("o_orderkey")
    return i.table(s, d, "orders").select(k.alias("id"), (0.01 + k % 200 / 100).alias("h"), (0.001 + k % 30 / 1000).alias("s"), (0.02 + k % 9 / 100).alias("n"), (2 + k % 10).cast("double").alias("w"))


@query(f"SELECT id, {R('pow(h, 2.0 / 3) * sqrt(s) / n AS v', 'pow(h, 2.0 / 3) * sqrt(s) / n * 30 * h AS sheet', 'pow(w * h / (w + 2 * h), 2.0 / 3) * sqrt(s) / n * w * h AS channel')} FROM ({_H})")
def h_manning(s, d):
    h, sl, n, w = (F.col(c) for c in "hsnw")
    return rounded(_hydro(s, d).select("id", hy.sheet_velocity(h, sl, n).alias("v"), hy.sheet_flow(h, sl, n, F.lit(SIZE)).alias("sheet"), hy.channel_flow(h, sl, n, w).alias("channel")))


@query(f"SELECT id, {R('w * h / n * pow(w * h / greatest(w + 2 * least(h, 0.8), 1e-12), 2.0 / 3) + 20 * (30 - w) * pow(greatest(h - 0.8, 0), 5.0 / 3) AS k', 'w * h + (30 - w) * greatest(h - 0.8, 0) AS area', 'CASE WHEN h <= 0.8 THEN h * w * 30 ELSE 0.8 * w * 30 + (h - 0.8) * 900 END AS v', 'h AS back')} FROM ({_H})")
def h_compound(s, d):
    h, n, w = (F.col(c) for c in "hnw")
    k, a = hy.conveyance(h, n, w, F.lit(0.8), F.lit(SIZE), F.lit(0.05))
    v = hy.volume(h, w * SIZE, F.lit(0.8), F.lit(900.0))
    return rounded(_hydro(s, d).select("id", k.alias("k"), a.alias("area"), v.alias("v"), hy.stage(v, w * SIZE, F.lit(0.8), F.lit(900.0)).alias("back")))


@query(f"SELECT id, {R('h AS depth', digits=5)} FROM ({_H})")
def h_normal(s, d):
    h, sl, n, w = (F.col(c) for c in "hsnw")
    return _hydro(s, d).select("id", F.round(hy.normal_depth(hy.channel_flow(h, sl, n, w), sl, n, w), 5).alias("depth"))


@query(f"""WITH {NET}, x AS (SELECT *, 0.1 + id % 50 / 100.0 AS h FROM flow) SELECT a.id, {R('CASE WHEN b.id IS NULL THEN 0.01 ELSE greatest((a.z - b.z) / a.dist + 0.8 * (a.h - b.h) / a.dist, 0) END AS slope',
    'CASE WHEN b.id IS NULL THEN a.h ELSE greatest(0.2 * a.h + 0.8 * (greatest(a.z + a.h, b.z + b.h) - greatest(a.z, b.z)), 1e-4) END AS depth')} FROM x a LEFT JOIN x b ON b.id = a.ds""")
def h_diffusive(s, d):
    x = i.net(s, d).select("id", "ds", "z", "dist", (0.1 + F.col("id") % 50 / 100).alias("h"))
    met = x.join(x.select(F.col("id").alias("ds"), F.col("z").alias("zb"), F.col("h").alias("hb")), "ds", "left")
    bed = F.coalesce((F.col("z") - F.col("zb")) / F.col("dist"), F.lit(0.01))
    return rounded(met.select("id", hy.water_slope(bed, F.col("h"), F.col("hb"), F.col("dist"), 0.8).alias("slope"), hy.diffusive_depth(F.col("h"), F.col("hb"), F.col("z"), F.col("zb"), 0.8, 1e-4).alias("depth")))


@query(f"SELECT id, {R('(0.9 * w / 10 + 0.05 * (w / 20 + w / 5) + 9.81 * h * 5 * s) / (1 + 9.81 * 5 * n * n * abs(w / 10) / pow(h, 7.0 / 3)) AS q')} FROM (SELECT id, h, s, n, CAST(w AS DOUBLE) AS w FROM ({_H}))")
def h_inertial(s, d):
    h, sl, n, w = (F.col(c) for c in "hsnw")
    return rounded(_hydro(s, d).select("id", hy.inertial(w / 10, w / 20, w / 5, h, sl, n, 5.0).alias("q")))


@query(f"SELECT id, {R('least(w, greatest(h - 0.5, 0) / 0.1) AS q')} FROM ({_H})")
def h_limiter(s, d):
    return rounded(_hydro(s, d).select("id", hy.limited(F.col("w"), F.col("h") - 0.5, 0.1).alias("q")))


@query(f"""SELECT id, {R('(cr + dg - 1) / (1 + cr + dg) AS c0', '(1 + cr - dg) / (1 + cr + dg) AS c1', '(1 - cr + dg) / (1 + cr + dg) AS c2', '2 * cr / (1 + cr + dg) AS c3')} FROM (SELECT id, 5.0 / 3 * pow(h, 2.0 / 3) * sqrt(s) / n * 20 / 30 AS cr, 0.6 * h / (s * 30) AS dg FROM ({_H}))""")
def h_mc_jacobi(s, d):
    h, sl, n, w = (F.col(c) for c in "hsnw")
    return rounded(_hydro(s, d).select("id", *[c.alias(k) for k, c in hy.muskingum_cunge(5 / 3 * hy.sheet_velocity(h, sl, n), w * h, w, sl, F.lit(SIZE), 20.0).items()]))


@query(f"SELECT {R('min(0.7 * 30 / greatest(5.0 / 3 * pow(h, 2.0 / 3) * sqrt(s) / n, 1e-12)) AS dt')} FROM ({_H})")
def rt_dt(s, d):
    h, sl, n = (F.col(c) for c in "hsn")
    return rounded(_hydro(s, d).agg(F.min(hy.courant_step(SIZE, hy.sheet_flow(h, sl, n, F.lit(SIZE)), h * SIZE)).alias("dt")))


# ================================================================ routing
@query(f"WITH {NET} SELECT ds AS id, {R('sum(z) AS inflow')} FROM flow WHERE ds IS NOT NULL GROUP BY ds")
def rt_scatter(s, d):
    return rounded(i.net(s, d).where("ds is not null").groupBy(F.col("ds").alias("id")).agg(F.sum("z").alias("inflow")))


def _routed(scheme):
    def run(s, d):
        net = i.net(s, d)
        slopes = terrain.slope(net, i.side(s, d), SIZE)
        ready = net.join(slopes, "id").select("id", "ds", "z", "slope", F.coalesce("dist", F.lit(SIZE)).alias("dist"), F.lit(0.05).alias("n"), "root")
        return rounded(kernels.routed(ready, [40 / 1000 / 3600] * 60 + [0.0], 4.0, 300, 30, scheme))

    return run


for _scheme in kernels.SCHEMES:
    query(None, f"rt_{_scheme}")(_routed(_scheme))


@query()
def rt_implicit(s, d):
    """Rivers have a channel in their cell; the rest are sheets."""
    net = i.net(s, d)
    width, depth = hy.geometry(F.col("facc") * 0.0009, "usa")
    river = F.col("facc") > 100
    ready = net.join(terrain.slope(net, i.side(s, d), SIZE), "id").select("id", "ds", "z", "slope", F.coalesce("dist", F.lit(SIZE)).alias("dist"), F.when(river, 0.035).otherwise(0.05).alias("n"), "root", F.when(river, width).otherwise(0.0).alias("width"), F.when(river, depth).otherwise(0.0).alias("bank"))
    return rounded(implicit.routed(ready, [40 / 1000 / 3600] * 6, 600.0, 7_200.0, 600.0))


_ZONES = f"""z AS (SELECT gauge_id, count(*) AS cells FROM near GROUP BY 1), a AS (SELECT gauge_id AS id, time_s AS t, depth_mm, 25400.0 / 75 - 254 AS s, sum(depth_mm) OVER (PARTITION BY gauge_id ORDER BY time_s ROWS UNBOUNDED PRECEDING) AS p FROM series),
    e AS (SELECT *, CASE WHEN p > 0.2 * s THEN (p - 0.2 * s) ** 2 / (p + 0.8 * s) ELSE 0 END AS pe FROM a), {_SCS}"""


def _zone_cells(s, d):
    return rain.thiessen(i.cells(s, d), i.gauges(s, d)).groupBy(F.col("gauge_id").alias("zone")).agg(F.count(F.lit(1)).alias("cells"))


def _zone_excess(s, d, late=True):
    depth = i.series(s, d).select(F.col("gauge_id").alias("id"), F.col("time_s").alias("t"), "depth_mm", F.lit(75.0).alias("cn"))
    return runoff.curve_number(depth, late=late).join(_zone_cells(s, d), F.col("id") == F.col("zone")).select("zone", F.col("t").alias("time_s"), "excess_mm", "cells")


@query(f"""WITH {CELLS}, {GAUGES}, {NEAR}, {RAIN}, {_ZONES}, b AS (SELECT id, sum(depth_mm) AS p, sum(mm) AS r, arg_max(own, t) AS w, max(s) AS s FROM x GROUP BY id)
    SELECT id AS zone, {R('p * cells * 0.9 AS rain_m3', 'r * cells * 0.9 AS runoff_m3', 'w * cells * 0.9 AS waiting_m3', '(p - if(p > 0.2 * s, (p - 0.2 * s) ** 2 / (p + 0.8 * s), 0)) * cells * 0.9 AS held_m3', digits=3)}, true AS closed FROM b JOIN z ON gauge_id = id""")
def rt_mass(s, d):
    """Ledger of each zone: rain against what has run off by the steps, what the last step has still to give, and what the soil holds by the closed formula of the whole storm."""
    rains = i.series(s, d).groupBy(F.col("gauge_id").alias("zone")).agg((F.sum("depth_mm")).alias("p"))
    late = _zone_excess(s, d).groupBy("zone").agg(F.sum("excess_mm").alias("r"))
    own = _zone_excess(s, d, False).groupBy("zone").agg(F.max_by("excess_mm", "time_s").alias("w"))
    keeps = 25400 / 75 - 254
    ran = F.when(F.col("p") > 0.2 * keeps, F.pow(F.col("p") - 0.2 * keeps, F.lit(2)) / (F.col("p") + 0.8 * keeps)).otherwise(0.0)
    m3 = F.col("cells") * SIZE * SIZE / 1000
    book = rains.join(late, "zone").join(own, "zone").join(_zone_cells(s, d), "zone").select("zone", *[(c * m3).alias(k) for k, c in {"rain_m3": F.col("p"), "runoff_m3": F.col("r"), "waiting_m3": F.col("w"), "held_m3": F.col("p") - ran}.items()])
    error = F.col("rain_m3") - F.col("runoff_m3") - F.col("waiting_m3") - F.col("held_m3")
    return rounded(book.withColumn("closed", F.abs(error) < 1e-6 * F.col("rain_m3")), 3)


@query(f"""WITH {CELLS}, {GAUGES}, {NEAR}, {RAIN}, z AS (SELECT gauge_id, count(*) AS cells FROM near GROUP BY 1),
    q AS (SELECT gauge_id, time_s, depth_mm * cells * 0.9 AS v, (gauge_id + 1) * 0.0577215664 AS i, sum(depth_mm) OVER (PARTITION BY gauge_id ORDER BY time_s ROWS UNBOUNDED PRECEDING) > 40 AS wet FROM series JOIN z USING (gauge_id)),
    m AS (SELECT *, v * i AS a, if(wet, v * (1 - i), 0) AS b, if(wet, 0, v * (1 - i) * 0.3) AS c FROM q)
    SELECT gauge_id AS zone, time_s, {R(*[f'sum({k}) OVER (PARTITION BY gauge_id ORDER BY time_s ROWS UNBOUNDED PRECEDING) AS {n}_m3' for k, n in (('a', 'imperv'), ('b', 'dunne'), ('c', 'horton'))], digits=4)} FROM m""")
def rt_part(s, d):
    """Cumulative volumes by mechanism: shed from sealed ground, and from soil that is full (after 40 mm) or takes up less than falls."""
    w = W.partitionBy("zone").orderBy("time_s").rowsBetween(W.unboundedPreceding, 0)
    given = i.series(s, d).join(_zone_cells(s, d), F.col("gauge_id") == F.col("zone")).select("zone", "time_s", (F.col("depth_mm") * F.col("cells") * SIZE * SIZE / 1000).alias("v"), (F.sum("depth_mm").over(w) > 40).alias("wet"))
    parts = runoff.combined(F.col("v"), (F.col("zone") + 1) * 0.0577215664, F.col("wet"), F.lit(0.3))
    return rounded(given.select("zone", "time_s", *[F.sum(c).over(w).alias(f"{k}_m3") for k, c in parts.items()]), 4)


@query(f"WITH {CELLS}, {GAUGES}, {NEAR}, {RAIN}, {_ZONES} SELECT id AS zone, floor(t / 86400) * 86400 AS time_s, {R('sum(mm * cells * 0.9) / 86400 + 0.05 AS q_m3s')} FROM x JOIN z ON gauge_id = id GROUP BY ALL")
def rt_hydro(s, d):
    """Mean flow out of each zone by day: volume by time, and a constant base flow."""
    v = _zone_excess(s, d).withColumn("v", F.col("excess_mm") * F.col("cells") * SIZE * SIZE / 1000)
    return rounded(v.groupBy("zone", (F.floor(F.col("time_s") / 86_400) * 86_400).cast("double").alias("time_s")).agg((F.sum("v") / 86_400 + 0.05).alias("q_m3s")))


@query(f"WITH RECURSIVE {FACC}, p AS (SELECT s_suppkey AS k, s_suppkey * 37 % n AS pr, s_suppkey * 53 % n AS pc FROM supplier, n0 WHERE s_suppkey < 10) SELECT k AS gauge_id, net.id AS cell FROM p JOIN net ON abs(r - pr) <= 5 AND abs(c - pc) <= 5 QUALIFY row_number() OVER (PARTITION BY k ORDER BY facc DESC, net.id) = 1")
def rt_gauge(s, d):
    return _snapped(s, d, 5)


@query(f"WITH RECURSIVE {FACC}, p AS (SELECT s_suppkey AS k, s_suppkey * 37 % n AS pr, s_suppkey * 53 % n AS pc FROM supplier, n0 WHERE s_suppkey < 10) SELECT k AS gauge_id, net.id AS cell FROM p JOIN net ON abs(r - pr) <= 3 AND abs(c - pc) <= 3 QUALIFY row_number() OVER (PARTITION BY k ORDER BY facc DESC, net.id) = 1")
def rt_bc(s, d):
    return _snapped(s, d, 3)


def _snapped(s, d, radius):
    """The largest river near each point: points are spread over the cells around them and met by row and column."""
    around = F.sequence(F.lit(-radius), F.lit(radius))
    p = i.gauges(s, d).select("gauge_id", F.floor(F.col("y") / SIZE).alias("pr"), F.floor(F.col("x") / SIZE).alias("pc"))
    near = p.select("gauge_id", "pr", "pc", F.explode(around).alias("a")).select("gauge_id", "pc", (F.col("pr") + F.col("a")).alias("r"), F.explode(around).alias("b")).select("gauge_id", "r", (F.col("pc") + F.col("b")).alias("c"))
    return i.net(s, d).join(near, ["r", "c"]).groupBy("gauge_id").agg(F.max(F.struct("facc", (-F.col("id")).alias("k"))).alias("m")).select("gauge_id", (-F.col("m.k")).alias("cell"))


@query(f"WITH {RAIN} SELECT gauge_id, time_s, {R('depth_mm')} FROM series WHERE time_s // 21600 % 4 = 0")
def rt_fields(s, d):
    return rounded(i.series(s, d).where(F.floor(F.col("time_s") / i.BUCKET) % 4 == 0))


@query(f"WITH {RAIN} SELECT gauge_id, {R('max(depth_mm) AS peak')}, CASE WHEN max(depth_mm) >= 1 THEN min(time_s) FILTER (WHERE depth_mm = m) END AS t_peak FROM (SELECT *, max(depth_mm) OVER (PARTITION BY gauge_id) AS m FROM series) GROUP BY gauge_id")
def rt_peak(s, d):
    best = i.series(s, d).groupBy("gauge_id").agg(F.max(F.struct("depth_mm", (-F.col("time_s")).alias("k"))).alias("m"))
    return rounded(best.select("gauge_id", F.col("m.depth_mm").alias("peak"), F.when(F.col("m.depth_mm") >= 1, -F.col("m.k")).alias("t_peak")))


@query(f"WITH {CELLS}, v AS (SELECT z, CASE WHEN id % 4 <> 0 THEN x END AS x FROM cells) SELECT 'z' AS name, count(z) AS n, {R('sum(z) AS total', 'sum(z * z) AS squares', 'min(z) AS least', 'max(z) AS most', digits=3)}, count(*) - count(z) AS missing FROM v UNION ALL SELECT 'x', count(x), round(sum(x), 3), round(sum(x * x), 3), round(min(x), 3), round(max(x), 3), count(*) - count(x) FROM v")
def rt_restart(s, d):
    state = i.cells(s, d).select("z", F.when(F.col("id") % 4 != 0, F.col("x")).alias("x"))
    return rounded(sinks.summary(state, ["z", "x"]), 3)


# ================================================================ flood maps
def _rivers(s, d):
    return i.net(s, d).withColumn("river", F.col("facc") > 100)


_RIVER = "rv AS (SELECT *, facc > 100 AS river FROM net), nd AS (SELECT src AS id, arg_min(cur, hops) AS drain FROM down JOIN rv ON rv.id = cur AND river GROUP BY src)"


@query(f"WITH RECURSIVE {FACC}, {_RIVER} SELECT net.id, drain FROM net LEFT JOIN nd USING (id)")
def f_nearest_drain(s, d):
    return flood.nearest_drain(_rivers(s, d))


@query(f"WITH RECURSIVE {FACC}, {_RIVER} SELECT a.id, {R('a.z - b.z AS hand')} FROM net a LEFT JOIN nd USING (id) LEFT JOIN net b ON b.id = drain")
def f_hand(s, d):
    return rounded(flood.above_drain(_rivers(s, d)).select("id", "hand"))


@query(f"WITH RECURSIVE {FACC}, {_RIVER} SELECT cur AS id, {R('min(a.z) AS bed')} FROM down JOIN rv a ON a.id = src AND a.river JOIN rv b ON b.id = cur AND b.river GROUP BY cur")
def f_bed(s, d):
    return rounded(flood.river_beds(_rivers(s, d)))


@query(f"WITH RECURSIVE {FACC}, {_RIVER} SELECT src AS id, {R('min(b.z + 0.015 * length) AS bed')} FROM down JOIN rv a ON a.id = src AND a.river JOIN rv b ON b.id = cur GROUP BY src")
def f_grade(s, d):
    rivers = _rivers(s, d).where("river").withColumn("low", -F.col("z"))
    return rounded(tree.path_max(rivers, "low", -0.015, "m").select("id", (-F.col("m")).alias("bed")))


@query(f"""WITH RECURSIVE {FACC}, rv AS (SELECT * FROM net WHERE facc > 100), dn AS (SELECT ds AS id, count(*) AS k FROM rv GROUP BY ds), e AS (SELECT rv.id, rv.ds, coalesce(rv.dist, 0) AS dist, rv.ds IS NULL OR dn.k > 1 AS stop FROM rv LEFT JOIN dn ON dn.id = rv.ds),
    w AS (SELECT src AS id, arg_min(cur, hops) AS link, min(length) AS length FROM down JOIN e ON e.id = cur AND stop JOIN rv ON rv.id = src GROUP BY src) SELECT w.link, count(*) AS cells, {R('max(w.length + e.dist) AS link_length')} FROM w JOIN e ON e.id = w.link GROUP BY w.link""")
def f_reaches(s, d):
    rivers = i.net(s, d).where("facc > 100").select("id", "ds", "dist")
    return rounded(tree.reaches(rivers, 300.0).groupBy("link").agg(F.count(F.lit(1)).alias("cells"), F.max("link_length").alias("link_length")))


@query("SELECT CAST(10 * pow(10, range) AS DOUBLE) AS level FROM range(19) WHERE range = 0 OR 10 * pow(10, range) < (SELECT floor(sqrt(count(*))) ** 2 FROM orders) / 2")
def f_levels(s, d):
    return flood.levels(s, 10, i.side(s, d) ** 2)


@query(f"WITH RECURSIVE {NET}, m AS (SELECT * FROM flow WHERE c % 9 <> 4), dm AS (SELECT id AS src, id AS cur FROM m UNION ALL SELECT d.src, f.ds FROM dm d JOIN m f ON f.id = d.cur JOIN m g ON g.id = f.ds) SELECT cur AS id, count(*) AS acc FROM dm GROUP BY cur")
def f_accwithin(s, d):
    net = i.net(s, d).select("id", "ds", "c", F.lit(1).alias("one")).withColumn("in", F.col("c") % 9 != 4)
    return flood.accumulate_within(net, "in", "one", "acc")


@query("SELECT CAST(row_number() OVER (ORDER BY y) - 1 AS INT) AS k, y FROM (SELECT range / 20.0 AS y FROM range(21) UNION ALL SELECT range / 5.0 FROM range(6, 51))")
def f_stage_grid(s, d):
    return flood.stages(s)


def _plain(s, d):
    hand = flood.above_drain(_rivers(s, d))
    net = i.net(s, d).select("id", "facc", "dist")
    w, _ = hy.geometry(F.col("facc") * 0.0009, "interior_highlands")
    return hand.join(net, "id").select("id", F.col("drain").alias("reach"), "hand", (F.col("facc") > 100).alias("drain"), (w * 1.5).alias("width"), F.coalesce("dist", F.lit(SIZE)).alias("dist"))


_PLAIN = f"""pl AS (SELECT a.id, drain AS reach, a.z - b.z AS hand, a.facc > 100 AS drain, 1.5 * 23.23 * pow(greatest(a.facc * 0.0009, 1e-6), 0.121) AS width, coalesce(a.dist, 30) AS dist FROM net a LEFT JOIN nd USING (id) LEFT JOIN net b ON b.id = drain),
    px AS (SELECT *, CASE WHEN drain THEN 900 - least(width * dist, 900) ELSE 900 END AS own, greatest(coalesce(sum(CASE WHEN drain THEN greatest((width - 30) * dist, 0) END) OVER (PARTITION BY reach), 0)
        - coalesce(sum(CASE WHEN NOT drain THEN 900.0 END) OVER (PARTITION BY reach ORDER BY hand NULLS LAST, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS lft FROM pl),
    fa AS (SELECT id, reach, hand, CASE WHEN drain OR reach IS NULL THEN own ELSE own - least(lft, own) END AS area FROM px)"""


@query(f"WITH RECURSIVE {FACC}, {_RIVER}, {_PLAIN} SELECT id, reach, {R('area', digits=4)} FROM fa")
def f_fp_area(s, d):
    return rounded(flood.plain_area(_plain(s, d), 900.0, SIZE), 4)


_YS = "ys AS (SELECT row_number() OVER (ORDER BY y) - 1 AS k, y FROM (SELECT range / 20.0 AS y FROM range(21) UNION ALL SELECT range / 5.0 FROM range(6, 51)))"
_CURVES = """fl AS (SELECT reach, k, sum(area * pow(y - greatest(hand, 0), 5.0 / 3) / 0.05) AS f, count(*) * 900.0 AS flooded FROM fa JOIN ys ON greatest(hand, 0) < y WHERE hand IS NOT NULL GROUP BY ALL),
    cv AS (SELECT r.reach, ys.k, y, 0.1 * (5 * (0.8 + y) / 0.035 * pow(5 * (0.8 + y) / (5 + 1.6), 2.0 / 3) + coalesce(f, 0) / 30) AS q, coalesce(flooded, 0) AS flooded FROM (SELECT DISTINCT reach FROM fa WHERE reach IS NOT NULL) r CROSS JOIN ys LEFT JOIN fl ON fl.reach = r.reach AND fl.k = ys.k)"""

def _curves(s, d):
    return _plain_curves(s, d, flood.stages(s))


@query(f"WITH RECURSIVE {FACC}, {_RIVER}, {_PLAIN}, {_YS}, {_CURVES} SELECT reach, CAST(k AS INT) AS k, {R('q', digits=3)}, flooded FROM cv")
def f_rating(s, d):
    return _curves(s, d).select("reach", "k", F.round("q", 3).alias("q"), "flooded")


def _plain_curves(s, d, ys):
    plain = _plain(s, d)
    cells = flood.plain_area(plain, 900.0, SIZE).join(plain.select("id", "hand"), "id").where("reach is not null")
    reach = cells.select("reach").distinct().select("reach", F.lit(30.0).alias("length"), F.lit(0.01).alias("slope"), F.lit(5.0).alias("width"), F.lit(0.8).alias("bank"), F.lit(0.035).alias("n"))
    return flood.rating(cells, reach, ys, 900.0, 0.05)


def _river_flow(s, d):
    """Flow of each river cell (reach) by time: the rain of its zone over all that drains to it."""
    rivers = i.net(s, d).where("facc > 100").select("id", "facc").join(rain.thiessen(i.cells(s, d), i.gauges(s, d)), "id")
    return rivers.join(i.rates(s, d), "gauge_id").select(F.col("id").alias("reach"), F.col("time_s").alias("t"), (F.col("rate") * F.col("facc") * SIZE * SIZE).alias("q"))


_FLOW = f"{GAUGES}, {NEAR}, {RAIN}, rf AS (SELECT net.id AS reach, time_s AS t, rate * facc * 900 AS q FROM net JOIN near USING (id) JOIN rates USING (gauge_id) WHERE facc > 100)"
_STAGE = """cn AS (SELECT *, lead(q) OVER w AS q1, lead(y) OVER w AS y1, first_value(y) OVER w AS y_first FROM cv WINDOW w AS (PARTITION BY reach ORDER BY k)),
    st AS (SELECT rf.reach, rf.t, CASE WHEN cn.q IS NULL THEN 0 WHEN q1 IS NULL THEN cn.y ELSE cn.y + (rf.q - cn.q) * (y1 - cn.y) / (q1 - cn.q) END AS y, cn.q IS NOT NULL AND q1 IS NULL AND rf.q > cn.q AS clipped FROM rf ASOF LEFT JOIN cn ON cn.reach = rf.reach AND cn.q <= rf.q)"""


@query(f"""WITH RECURSIVE {FACC}, {_RIVER}, {_PLAIN}, {_FLOW}, ys AS (SELECT * FROM (VALUES (0, 10.0), (1, 20.0), (2, 40.0), (3, 80.0), (4, 100.0)) v(k, y)), {_CURVES}
    SELECT p.reach, coalesce(min(y) FILTER (WHERE cv.q >= p.q), 100) AS y_max, count(*) FILTER (WHERE cv.q >= p.q) > 0 AS fits FROM (SELECT reach, 300 * max(q) AS q FROM rf GROUP BY 1) p JOIN cv USING (reach) GROUP BY 1""")
def f_rating_fit(s, d):
    """How high each reach's curve has to go to hold its peak (here of a flood three hundred times the rain's): doubled from 10 m, at most 100 m."""
    tops = s.createDataFrame(list(enumerate((10.0, 20.0, 40.0, 80.0, 100.0))), "k int, y double")
    peaks = _river_flow(s, d).groupBy("reach").agg((F.max("q") * 300).alias("peak"))
    fits = F.col("q") >= F.col("peak")
    return _plain_curves(s, d, tops).join(peaks, "reach").groupBy("reach").agg(F.coalesce(F.min(F.when(fits, F.col("y"))), F.lit(100.0)).alias("y_max"), (F.count_if(fits) > 0).alias("fits"))


def _stages(s, d):
    """Stage of each reach by time, built once."""
    return once(s, ("stages", d), lambda: flood.stage_of(_river_flow(s, d).withColumn("q", F.col("q") * 30), _curves(s, d).select("reach", "y", "q")))


_FLOOD = _FLOW.replace("rate * facc * 900 AS q", "rate * facc * 27000 AS q")


@query(f"WITH RECURSIVE {FACC}, {_RIVER}, {_PLAIN}, {_FLOOD}, {_YS}, {_CURVES}, {_STAGE} SELECT reach, t, {R('y')}, clipped FROM st")
def f_stage(s, d):
    return rounded(_stages(s, d).select("reach", "t", "y", "clipped"))


@query(f"""WITH RECURSIVE {FACC}, {_RIVER}, {_FLOOD}, rc AS (SELECT * FROM net WHERE facc > 100), dn AS (SELECT ds AS id, count(*) AS k FROM rc GROUP BY ds), en AS (SELECT rc.id, rc.ds IS NULL OR dn.k > 1 AS stop FROM rc LEFT JOIN dn ON dn.id = rc.ds),
    w AS (SELECT src AS id, arg_min(cur, hops) AS link FROM down JOIN en ON en.id = cur AND stop JOIN rc ON rc.id = src GROUP BY src), pk AS (SELECT reach AS id, max(q) AS q, arg_max(t, q) AS t FROM rf GROUP BY 1)
    SELECT link, {R('avg(z) AS bed', 'avg(2.70 * pow(greatest(facc * 0.0009, 1e-6), 0.352)) AS width', 'max(facc) * 0.0009 AS area_km2', 'max(q) AS q', digits=11)}, arg_max(rc.id, (q, -rc.id)) AS cell, arg_max(t, (q, -rc.id)) AS t FROM w JOIN rc USING (id) JOIN pk USING (id) GROUP BY link""")
def f_level(s, d):
    """Links of the rivers: means of their cells, the largest area, and the largest flow at any cell with its time."""
    rivers = i.net(s, d).where("facc > 100")
    links = tree.reaches(rivers.select("id", "ds", "dist"), 1e9).select("id", "link")
    peaks = _river_flow(s, d).groupBy(F.col("reach").alias("id")).agg((F.max("q") * 30).alias("q"), F.max_by("t", "q").alias("t"))
    w, _ = hy.geometry(F.col("facc") * 0.0009, "usa")
    best = F.max(F.struct("q", (-F.col("id")).alias("k"), "t")).alias("m")
    met = rivers.join(links, "id").join(peaks, "id").groupBy("link").agg(F.avg("z").alias("bed"), F.avg(w).alias("width"), (F.max("facc") * 0.0009).alias("area_km2"), best)
    return rounded(met.select("link", "bed", "width", "area_km2", F.col("m.q").alias("q"), (-F.col("m.k")).alias("cell"), F.col("m.t").alias("t")), 11)


@query(f"""WITH RECURSIVE {FACC}, {_RIVER}, {_PLAIN}, {_FLOOD}, {_YS}, {_CURVES}, {_STAGE} SELECT fa.id, min(t) FILTER (WHERE y - hand > 0.1) AS first_time, count(*) FILTER (WHERE y - hand > 0.1) * 21600.0 AS duration
    FROM fa JOIN st USING (reach) GROUP BY fa.id""")
def f_firstdur(s, d):
    """When each cell is first more than 0.1 m deep, and for how long in all. Cells meet their reach's stages as one short array."""
    series = _stages(s, d).groupBy("reach").agg(F.array_sort(F.collect_list(F.struct("t", "y"))).alias("s"))
    cells = flood.above_drain(_rivers(s, d)).where("drain is not null").select("id", F.col("drain").alias("reach"), "hand")
    wet = F.filter("s", lambda x: x["y"] - F.col("hand") > 0.1)
    return cells.join(series, "reach").select("id", F.try_element_at(wet, F.lit(1))["t"].alias("first_time"), (F.size(wet) * 21_600.0).alias("duration"))


@query(f"""WITH RECURSIVE {FACC}, {_RIVER}, h AS (SELECT a.id, drain AS reach, a.z - b.z AS hand FROM net a JOIN nd USING (id) JOIN net b ON b.id = drain), st AS (SELECT reach, l.range AS level, (reach * (l.range + 1) % 40) / 10.0 AS y FROM (SELECT DISTINCT reach FROM h), range(3) l),
    m AS (SELECT id, level, greatest(y - hand, 0) AS depth FROM h JOIN st USING (reach)) SELECT id, {R('depth')}, level FROM m QUALIFY row_number() OVER (PARTITION BY id ORDER BY depth DESC, level) = 1""")
def f_depth(s, d):
    cells = flood.above_drain(_rivers(s, d)).where("drain is not null").select("id", F.col("drain").alias("reach"), "hand")
    stages = cells.select("reach").distinct().select("reach", F.explode(F.sequence(F.lit(0), F.lit(2)).cast("array<bigint>")).alias("level"))
    return rounded(flood.depths(cells, stages.withColumn("y", F.col("reach") * (F.col("level") + 1) % 40 / 10)))


@query(f"WITH {CELLS} SELECT id FROM cells WHERE x + 15 > 200 AND x - 15 < 700 AND y + 15 > 100 AND y - 15 < 500")
def f_area_window(s, d):
    x, y = F.col("x"), F.col("y")
    return i.cells(s, d).where((x + 15 > 200) & (x - 15 < 700) & (y + 15 > 100) & (y - 15 < 500)).select("id")


@query(f"""WITH RECURSIVE {FACC}, {_RIVER}, {_PLAIN}, {_FLOOD}, {_YS}, {_CURVES}, {_STAGE}, ca AS (SELECT reach, y AS y0, flooded AS a0, lead(y) OVER w AS y2, lead(flooded) OVER w AS a2 FROM cv WINDOW w AS (PARTITION BY reach ORDER BY k))
    SELECT t, round(sum(CASE WHEN y2 IS NULL THEN a0 ELSE a0 + (a2 - a0) * (y - y0) / (y2 - y0) END) / 1e6, 6) AS km2 FROM st ASOF JOIN ca ON ca.reach = st.reach AND ca.y0 <= st.y GROUP BY t""")
def f_areaseries(s, d):
    """Flooded land by time: each reach's area at its stage, between two points of its curve."""
    curves = _curves(s, d).select("reach", F.col("y").alias("q"), F.col("flooded").alias("y"))
    area = flood.stage_of(_stages(s, d).select("reach", "t", F.col("y").alias("q")), curves)
    return area.groupBy("t").agg(F.round(F.sum("y") / 1e6, 6).alias("km2"))


@query(f"WITH RECURSIVE {FACC}, fine AS (SELECT * FROM net WHERE facc > 20 AND id % 3 = 0), co AS (SELECT * FROM net WHERE facc > 20 AND id % 3 = 1), m AS (SELECT a.id, b.id AS other, abs(ln(a.facc / b.facc)) AS gap FROM fine a JOIN co b ON abs(a.r - b.r) <= 5 AND abs(a.c - b.c) <= 5 AND (a.r - b.r) ** 2 + (a.c - b.c) ** 2 <= 25 WHERE abs(ln(a.facc / b.facc)) <= ln(1.5) QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY gap, b.id) = 1) SELECT fine.id, {R('gap', digits=9)} FROM fine LEFT JOIN m USING (id)")
def f_fine_match(s, d):
    net = i.net(s, d).where("facc > 20").select("id", F.col("c").alias("x"), F.col("r").alias("y"), F.col("facc").alias("a"))
    coarse = net.where("id % 3 = 1")
    out = flood.matched(net.where("id % 3 = 0"), coarse, 5, 5.0)
    met = out.join(net.select("id", "a"), "id").join(coarse.select(F.col("id").alias("other"), F.col("a").alias("oa")), "other", "left")
    return met.select("id", F.round(F.abs(F.ln(F.col("a") / F.col("oa"))), 9).alias("gap"))


@query(f"WITH RECURSIVE {FACC} SELECT r // 10 AS block, arg_min(id, z) AS entry FROM net WHERE c = 0 OR c = n - 1 GROUP BY 1")
def f_entries(s, d):
    edge = i.net(s, d).where((F.col("c") == 0) | (F.col("c") == i.side(s, d) - 1))
    return edge.groupBy(F.floor(F.col("r") / 10).alias("block")).agg(F.min_by("id", F.struct("z", "id")).alias("entry"))


@query(f"WITH RECURSIVE {FACC}, b AS (SELECT *, r BETWEEN 10 AND 25 AND c BETWEEN 8 AND 30 AS within FROM net) SELECT a.id AS inlet, b.id AS enters, a.facc FROM b a JOIN b ON b.id = a.ds WHERE NOT a.within AND b.within AND a.facc > 5")
def f_blocked(s, d):
    """Rivers that enter a box: the cells outside that are closed, and those inside that get their water."""
    net = i.net(s, d).withColumn("within", F.col("r").between(10, 25) & F.col("c").between(8, 30))
    below = net.where("within").select(F.col("id").alias("ds"), F.col("id").alias("enters"))
    return net.where("not within and facc > 5").join(below, "ds").select(F.col("id").alias("inlet"), "enters", "facc")


@query(f"WITH RECURSIVE {FACC}, {_FLOW} SELECT reach AS cell, floor(t / 86400) * 86400 AS day, {R('avg(q) AS mean', 'max(q) AS peak', digits=12)}, arg_max(t, (q, -t)) AS t_peak, count(*) AS records FROM rf GROUP BY ALL")
def f_recorder(s, d):
    """Mean, peak and its time of each river cell by day."""
    flow = _river_flow(s, d).groupBy(F.col("reach").alias("cell"), (F.floor(F.col("t") / 86_400) * 86_400).cast("double").alias("day"))
    best = flow.agg(F.avg("q").alias("mean"), F.max(F.struct("q", (-F.col("t")).alias("k"))).alias("m"), F.count(F.lit(1)).alias("records"))
    return rounded(best.select("cell", "day", "mean", F.col("m.q").alias("peak"), (-F.col("m.k")).alias("t_peak"), "records"), 12)


@query()
def f_2d_solver(s, d):
    box = i.cells(s, d).select("id", "r", "c", "z", (F.floor(F.col("r") / 20) * 100_000 + F.floor(F.col("c") / 20)).alias("box"), F.when(F.col("r") % 20 < 5, 1e-4).otherwise(0.0).alias("source"))
    return rounded(kernels.flood_boxes(box, 600.0), 4)


@query("WITH h AS (SELECT user_id % 10 AS river, CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS t, sum(value) AS q FROM events GROUP BY ALL), m AS (SELECT *, max(q) OVER (PARTITION BY river) AS top FROM h) SELECT river, min(t) FILTER (WHERE q >= 0.3 * top) AS begins, max(t) FILTER (WHERE q >= 0.3 * top) + 86400 AS ends FROM m GROUP BY river")
def f_2d_box(s, d):
    t = (F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600) * 3600).cast("bigint")
    h = i.table(s, d, "events").groupBy((F.col("user_id") % 10).alias("river"), t.alias("t")).agg(F.sum("value").alias("q"))
    m = h.withColumn("rise", F.col("q") >= 0.3 * F.max("q").over(W.partitionBy("river")))
    return m.where("rise").groupBy("river").agg(F.min("t").alias("begins"), (F.max("t") + 86_400).alias("ends"))


@query()
def f_pools(s, d):
    low = i.cells(s, d).where("z - floor(z) < 0.15")
    return flood.pools(low.select("id", "r", "c")).orderBy(F.desc("cells"), "pool").limit(3)


# ================================================================ skill and sweeps
_PAIRS = """o AS (SELECT CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) / 1e6 AS obs FROM orders GROUP BY 1), l AS (SELECT CAST(l_shipdate AS DATE) AS day, sum(l_extendedprice * (1 - l_discount)) / 1e6 AS mod FROM lineitem GROUP BY 1),
    pairs AS (SELECT year(day) AS event, day, epoch(day)::DOUBLE AS t, obs, mod FROM o JOIN l USING (day))"""


def _pairs(s, d):
    obs = i.table(s, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg((F.sum("o_totalprice") / 1e6).alias("obs"))
    mod = i.table(s, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg((F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / 1e6).alias("mod"))
    return obs.join(mod, "day").select(F.year("day").cast("bigint").alias("event"), F.unix_timestamp(F.col("day").cast("timestamp")).cast("double").alias("t"), "obs", "mod")


@query(f"WITH {_PAIRS}, a AS (SELECT *, avg(obs) OVER (PARTITION BY event) AS m FROM pairs) SELECT event, {R('1 - sum((obs - mod) ** 2) / sum((obs - m) ** 2) AS nse', '100 * sum(mod - obs) / sum(obs) AS pbias', 'max(obs) AS peak_obs', 'max(mod) AS peak_mod')}, arg_max(t, obs) AS t_obs, arg_max(t, mod) AS t_mod FROM a GROUP BY event")
def m_nse_pbias(s, d):
    return rounded(skill.scores(_pairs(s, d), "event"))


#: The axes of the factorial sweep, and the single-factor experiments.
SWEEP = {"channel": ["off", "on"], "scheme": ["kinematic", "diffusive", "muskingum"], "mechanisms": ["vsa", "horton", "impervious", "vsa+horton", "vsa+impervious", "horton+impervious", "vsa+horton+impervious"], "infiltration": ["green_ampt", "none"], "reducer": ["max", "divide"]}
EXPERIMENTS = {
    "A_mechanism": ["A0_full", "A1_no_horton", "A2_no_imperv", "A3_dunne_only", "A4_horton_imperv", "A5_imperv_only", "A6_horton_only"], "B_sd": ["sd_0.05", "sd_0.10", "sd_0.20", "sd_0.40", "sd_0.80"],
    "C_routing": ["kinematic", "muskingum", "diff_theta_0.25", "diff_theta_0.50", "diff_theta_0.75"], "D_ksat": ["ksat_0.5", "ksat_2.0", "ksat_4.0"], "E_channel": ["off", "width_0.5x", "width_2.0x"], "F_sdreducer": ["mean", "divide"],
}


def _axis(name: str, values: list[str]) -> str:
    return f"(VALUES {', '.join(f"('{v}')" for v in values)}) {name}_({name})"


@query(f"SELECT * FROM {', '.join(_axis(k, v) for k, v in SWEEP.items())}")
def m_grid(s, d):
    return skill.factorial(s, SWEEP)


@query(f"SELECT factor, tag, CAST(e.range AS INT) AS event FROM (VALUES {', '.join(f"('{k}', '{t}')" for k, v in EXPERIMENTS.items() for t in v)}) x(factor, tag), range(4) e")
def m_ofat(s, d):
    rows = s.createDataFrame([(k, t) for k, v in EXPERIMENTS.items() for t in v], "factor string, tag string")
    return rows.withColumn("event", F.explode(F.sequence(F.lit(0), F.lit(3))))


@query("WITH last AS (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) = 1) SELECT o_orderkey AS tag, round(o_totalprice, 4) AS metric, round(l_extendedprice, 4) AS ledger FROM orders LEFT JOIN last ON l_orderkey = o_orderkey")
def m_master(s, d):
    line = i.table(s, d, "lineitem").select("l_orderkey", "l_extendedprice", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("at"))
    last = skill.last_per_tag(line, "l_orderkey", "at")
    return i.table(s, d, "orders").join(last, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("tag"), F.round("o_totalprice", 4).alias("metric"), F.round("l_extendedprice", 4).alias("ledger"))


@query("SELECT o_orderpriority AS config, round(avg(o_totalprice), 4) AS mean, CAST(rank() OVER (ORDER BY avg(o_totalprice) DESC) AS INT) AS place FROM orders GROUP BY 1")
def m_means(s, d):
    means = i.table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("config")).agg(F.avg("o_totalprice").alias("m"))
    return means.select("config", F.round("m", 4).alias("mean"), F.rank().over(W.orderBy(F.desc("m"))).alias("place"))  # one row a configuration


@query("""WITH x AS (SELECT 'priority' AS factor, o_orderpriority AS setting, o_totalprice AS v FROM orders UNION ALL SELECT 'status', o_orderstatus, o_totalprice FROM orders),
    m AS (SELECT factor, setting, avg(v) AS mean, stddev_samp(v) AS sd FROM x GROUP BY ALL) SELECT factor, setting, round(mean, 4) AS mean, round(sd, 4) AS sd, round(max(mean) OVER (PARTITION BY factor) - min(mean) OVER (PARTITION BY factor), 4) AS span FROM m""")
def m_effects(s, d):
    runs = i.table(s, d, "orders").select(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), "o_totalprice")
    return rounded(skill.effects(runs, ["priority", "status"], "o_totalprice"), 4)


@query("WITH p AS (SELECT l_orderkey AS id, sum(l_quantity * 10) AS a, sum(l_extendedprice / 150) AS b, sum(l_tax * 5000) AS c FROM lineitem GROUP BY 1) SELECT id, CASE WHEN greatest(a, b, c) <= 0 THEN -1 WHEN a = greatest(a, b, c) THEN 0 WHEN b = greatest(a, b, c) THEN 1 ELSE 2 END AS mechanism FROM p")
def m_dominant(s, d):
    """Lines are added in the order of the table, as one thread of SQL does; with more threads its sums, and exact ties with them, vary."""
    parts = i.table(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_quantity") * 10).alias("imperv"), (F.col("l_extendedprice") / 150).alias("dunne"), (F.col("l_tax") * 5000).alias("horton"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return skill.dominant(parts, ["file", "row"])


@query(f"WITH {_PAIRS} SELECT event, arg_max(t, mod) - arg_max(t, obs) AS lag_s, count(*) AS days FROM pairs GROUP BY event")
def m_timing(s, d):
    late = lambda v: F.max_by("t", F.struct(v, (-F.col("t")).alias("k")))
    return _pairs(s, d).groupBy("event").agg((late("mod") - late("obs")).alias("lag_s"), F.count(F.lit(1)).alias("days"))


# ================================================================ relational forms that occur
@query(f"WITH {RAIN} SELECT time_s, round(max(CASE WHEN gauge_id = 0 THEN depth_mm END), 6) AS g0, round(max(CASE WHEN gauge_id = 1 THEN depth_mm END), 6) AS g1, round(max(CASE WHEN gauge_id = 2 THEN depth_mm END), 6) AS g2 FROM series GROUP BY time_s")
def snk_gauges(s, d):
    named = i.series(s, d).withColumn("gauge_id", F.concat(F.lit("g"), "gauge_id"))
    return rounded(sinks.wide_gauges(named, ["g0", "g1", "g2"], ["depth_mm"]))


@query(f"WITH {RAIN} SELECT time_s, time_s / 3600 AS time_hr, {R('sum(depth_mm) AS q')} FROM series GROUP BY time_s")
def snk_hydro(s, d):
    return rounded(i.series(s, d).groupBy("time_s").agg(F.sum("depth_mm").alias("q")).withColumn("time_hr", F.col("time_s") / 3600))


def _written(s, name):
    return f"{folder(s)}/{name}-{uuid.uuid4().hex}"


_PART_TOTAL = "SELECT time_s, time_s / 3600 AS time_hr, " + R(*[f"sum({n}_m3) AS {n}_m3" for n in ("dunne", "horton", "imperv")], digits=4)


@query(f"{_PART_TOTAL} FROM ({ORACLES['rt_part']}) GROUP BY time_s")
def snk_partition(s, d):
    """The cumulative series of all zones, written and read again."""
    where = _written(s, "partition")
    total = QUERIES["rt_part"](s, d).groupBy("time_s").agg(*[F.sum(f"{n}_m3").alias(f"{n}_m3") for n in ("dunne", "horton", "imperv")])
    sinks.write_tables({"partition": total.select("time_s", (F.col("time_s") / 3600).alias("time_hr"), "dunne_m3", "horton_m3", "imperv_m3")}, where)
    return rounded(s.read.csv(f"{where}/partition", header=True, schema="time_s double, time_hr double, dunne_m3 double, horton_m3 double, imperv_m3 double"), 4)


@query(f"SELECT tag, zone, rain_m3, runoff_m3, closed FROM (VALUES ('first'), ('second')) t(tag), ({ORACLES['rt_mass']})")
def snk_ledger(s, d):
    """Two runs' rows, added one after the other."""
    where = _written(s, "ledger")
    for tag in ("first", "second"):
        sinks.append_ledger(QUERIES["rt_mass"](s, d).select(F.lit(tag).alias("tag"), "zone", "rain_m3", "runoff_m3", "closed"), where)
    return s.read.parquet(where)


@query(f"WITH {CELLS}, {GAUGES}, {NEAR}, {RAIN}, {_ZONES} SELECT id AS zone, {R('mm AS excess_mm')} FROM x WHERE t = 432000")
def snk_fields(s, d):
    """Fields by time; one frame is read without the others."""
    where = _written(s, "fields")
    sinks.write_fields(_zone_excess(s, d).select("zone", "time_s", "excess_mm"), where)
    return rounded(s.read.parquet(where).where("time_s = 432000").select("zone", "excess_mm"))


@query(f"WITH {NET} SELECT id, {R('z * 0.01 AS volume')} FROM flow")
def snk_state(s, d):
    """A state, saved and taken up again by a run of the same grid, scheme and parameters."""
    where, net = _written(s, "state"), i.net(s, d)
    sinks.write_state(net.select("id", (F.col("z") * 0.01).alias("volume")), where, 6.0, net, "implicit", ["z", "dist"])
    return rounded(sinks.read_state(s, where, 6.0, net, "implicit", ["z", "dist"]))


@query(f"SELECT link, cell, round(q, 4) AS q FROM ({ORACLES['f_level']})")
def snk_tables(s, d):
    where = _written(s, "tables")
    sinks.write_tables({"reaches": QUERIES["f_level"](s, d)}, where)
    return s.read.csv(f"{where}/reaches", header=True, inferSchema=True).select(F.col("link").cast("bigint").alias("link"), F.col("cell").cast("bigint").alias("cell"), F.round("q", 4).alias("q"))


@query()
def rt_tree_solve(s, d):
    net = i.net(s, d).select("id", "ds", "root", "z", F.when(F.col("ds").isNotNull(), 1 + F.col("id") % 5).otherwise(0).cast("double").alias("face"))
    above = net.where("ds is not null").groupBy(F.col("ds").alias("id")).agg(F.sum("face").alias("from"))
    return rounded(implicit.solved(net.join(above, "id", "left").select("id", "ds", "root", "face", (1 + F.col("face") + F.coalesce("from", F.lit(0.0))).alias("diagonal"), F.col("z").alias("given"))))


@query()
def snk_geojson(s, d):
    net = i.net(s, d).where("facc > 500")
    return sinks.outlines(net.select(F.lit(0).alias("line"), (-F.col("hops")).alias("k"), "x", "y"))


@query("SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def rel_anti(s, d):
    heavy = i.table(s, d, "lineitem").where("l_quantity > 49")
    return i.table(s, d, "part").join(heavy, F.col("p_partkey") == F.col("l_partkey"), "left_anti").select(F.col("p_partkey").alias("id"))


@query("SELECT c_custkey AS id FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def rel_semi(s, d):
    large = i.table(s, d, "orders").where("o_totalprice > 300000")
    return i.table(s, d, "customer").join(large, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select(F.col("c_custkey").alias("id"))


@query("SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def rel_except(s, d):
    o = i.table(s, d, "orders").select("o_orderstatus", F.col("o_custkey").alias("id"))
    return o.where("o_orderstatus = 'F'").select("id").subtract(o.where("o_orderstatus = 'O'").select("id"))


@query("SELECT * FROM (SELECT o_orderkey AS id, o_totalprice AS v FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 3)")
def rel_topk(s, d):
    return i.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v")).orderBy(F.desc("v"), "id").limit(3)


@query("SELECT o_orderpriority AS k, round(quantile_cont(o_totalprice, 0.5), 1) AS median, round(quantile_cont(o_totalprice, 0.9), 1) AS p90, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def rel_percentiles(s, d):
    return rounded(i.table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("k")).agg(F.median("o_totalprice").alias("median"), F.percentile("o_totalprice", F.lit(0.9)).alias("p90"), F.countDistinct("o_custkey").alias("customers")), 1)


# ================================================================ one slice from rain to hydrograph
@query(f"WITH {CELLS}, {GAUGES}, {NEAR}, {RAIN}, {_ZONES} SELECT id AS zone, t AS time_s, {R('mm * cells * 900 / 1000 / 21600 AS q')} FROM x JOIN z ON gauge_id = id")
def flagship_zone_hydrograph(s, d):
    return rounded(_zone_excess(s, d).select("zone", "time_s", (F.col("excess_mm") * F.col("cells") * SIZE * SIZE / 1000 / i.BUCKET).alias("q")))
