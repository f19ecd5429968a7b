"""More queries, one for each operator that the main list leaves out, with their SQL; sources are tested by round trips."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import angles, gps, interpolate, register, signal, text
from ..functions import index as ix
from ..functions.types import vectorized
from ..operators import credible, crossmatch, density, events, image, modes, stats
from ..operators.prefix import cumulative_by_range
from ..sources import fits, tables
from ..storage import shared_folder
from . import geometry_sql as geo
from .fixtures import FLAT, SKY, flat_map, line_pixels, sky_map, table
from .queries import _FAR, CUSTOMERS, DISTANCES, FOUND, GREEDY, VOXELS, _catalog, _density_map, _distance_map, _modes_sql, _ranked, _suppliers, query


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _local(folder: str) -> str:
    """A folder as executors write it with a file system of their own."""
    return folder.removeprefix("file://") if folder.startswith("file:///") else folder.removeprefix("file:") if folder.startswith("file:/") else folder


# --- index and geometry


@query(f"SELECT k AS cell_order, p AS ipix, round(acos(z), 9) AS theta, round(phi, 9) AS phi FROM {geo.cells('(SELECT DISTINCT c_custkey % 4 AS k, c_custkey * 7 % (12 * pow(4, c_custkey % 4))::BIGINT AS p FROM customer)')}")
def cell_centres(spark, sf_dir):
    order = F.col("c_custkey") % 4
    cells = table(spark, sf_dir, "customer").select(order.alias("cell_order"), (F.col("c_custkey") * 7 % (12 * F.pow(F.lit(4), order)).cast("long")).alias("ipix")).distinct()
    a = cells.withColumn("a", ix.uniq2ang(ix.nest2uniq("cell_order", "ipix")))
    return a.select("cell_order", "ipix", F.round("a.theta", 9).alias("theta"), F.round("a.phi", 9).alias("phi"))


@query(f"SELECT p AS ipix, ring, p AS back FROM (SELECT p, row_number() OVER (ORDER BY round(z, 9) DESC, round(phi, 9)) - 1 AS ring FROM {geo.cells('(SELECT 3 AS k, p FROM range(768) r(p))')}) WHERE p IN (SELECT c_custkey % 768 FROM customer)")
def ring_index(spark, sf_dir):
    p = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 768).alias("ipix")).distinct().withColumn("ring", ix.nest2ring(F.lit(3), F.col("ipix")))
    return p.withColumn("back", ix.ring2nest(F.lit(3), F.col("ring")))


@query(f"SELECT id, p AS ipix FROM {geo.lookup(f'({CUSTOMERS})', 3)}")
def direction_to_cell(spark, sf_dir):
    c = _catalog(spark, sf_dir)
    return c.select("id", ix.zphi2nest(F.lit(3), F.col("sine"), F.col("ra")).alias("ipix"))


@query(f"SELECT DISTINCT a.p AS ipix, b.p AS near FROM {geo.corners(3)} a JOIN {geo.corners(3)} b ON a.key = b.key AND a.p <> b.p WHERE a.p IN (SELECT c_custkey * 5 % 768 FROM customer)")
def cell_neighbours(spark, sf_dir):
    p = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 5 % 768).alias("ipix")).distinct()
    return p.select("ipix", F.explode(ix.neighbours(F.lit(3), F.col("ipix"))).alias("near")).where("near >= 0").distinct()


@query(f"""WITH {FLAT}, c AS (SELECT map_id, ipix FROM flat WHERE w % 2 = 0) SELECT a.map_id, a.ipix, count(*) AS n FROM c a
    JOIN (SELECT DISTINCT x.p AS a, y.p AS b FROM {geo.corners(2)} x JOIN {geo.corners(2)} y ON x.key = y.key AND x.p <> y.p) e ON e.a = a.ipix JOIN c b ON b.map_id = a.map_id AND b.ipix = e.b GROUP BY 1, 2""")
def neighbour_join(spark, sf_dir):
    c = flat_map(spark, sf_dir).where("w % 2 = 0").select("map_id", "ipix")
    near = c.select("map_id", "ipix", F.explode(ix.neighbours(F.lit(2), F.col("ipix"))).alias("_n"))
    return near.join(c.withColumnRenamed("ipix", "_n"), ["map_id", "_n"]).groupBy("map_id", "ipix").agg(F.count(F.lit(1)).alias("n"))


# --- scalar functions


@query("""SELECT event_id, round(40587 + (t + 315964800 - n) / 86400.0::DOUBLE, 9) AS mjd FROM (
    SELECT event_id, t, (SELECT count(*) FROM (VALUES (46828800), (78364801), (109900802), (173059203), (252028804), (315187205), (346723206), (393984007), (425520008),
        (457056009), (504489610), (551750411), (599184012), (820108813), (914803214), (1025136015), (1119744016), (1167264017)) l(s) WHERE t >= s) AS n
    FROM (SELECT event_id, 40000000 + event_id * 97777 % 1300000000 AS t FROM events))""")
def gps_to_mjd(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.round(gps.gps_to_mjd(40000000 + F.col("event_id") * 97777 % 1300000000), 9).alias("mjd"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_id::VARCHAR WHEN 1 THEN event_id::VARCHAR ELSE 'G' || event_id END AS objid FROM events""")
def normalize_objid(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    raw = F.when(F.col("event_id") % 3 == 0, F.col("event_id").cast("string")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("coinc_event:coinc_event_id:"), F.col("event_id"))).otherwise(F.concat(F.lit("G"), F.col("event_id")))
    return e.select("event_id", gps.normalize_objid(raw).alias("objid"))


@query("SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, '|' ORDER BY c_mktsegment) AS instruments FROM customer GROUP BY 1")
def instruments_from_text(spark, sf_dir):
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_join(F.collect_set("c_mktsegment"), " , ").alias("v"))
    return c.select("c_nationkey", F.array_join(gps.instruments_from_text("v"), "|").alias("instruments"))


@query("SELECT p_partkey, CASE WHEN a <= 100 THEN printf('%.3g', a) ELSE format('{:,}', round_even(a, 0)::BIGINT) END AS area FROM (SELECT p_partkey, (p_retailprice * (p_partkey % 7) / 50)::DOUBLE + 0.5 AS a FROM part)")
def format_area(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", text.format_area(F.col("p_retailprice") * (F.col("p_partkey") % 7) / 50 + 0.5).alias("area"))


@query("SELECT p_partkey, round(pow(m1 * m2, 0.6) * pow(m1 + m2, -0.2), 9) AS mchirp FROM (SELECT p_partkey, 1 + p_size / 10.0::DOUBLE AS m1, 1 + p_partkey % 13 / 5.0::DOUBLE AS m2 FROM part)")
def chirp_mass(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (1 + F.col("p_size") / 10.0).alias("m1"), (1 + F.col("p_partkey") % 13 / 5.0).alias("m2"))
    return p.select("p_partkey", F.round(events.chirp_mass("m1", "m2"), 9).alias("mchirp"))


@query("SELECT c_custkey, round((sin(a + 0.5) - sin(a - 0.5)) / 1.0, 9) AS slope FROM (SELECT c_custkey, c_acctbal / 1000 AS a FROM customer)")
def derivative(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("a", F.col("c_acctbal") / 1000)
    return c.select("c_custkey", F.round(signal.derivative(F.sin, F.col("a"), 0.5), 9).alias("slope"))


_CATMULL = "(z1 + 0.5 * t * (z2 - z0 + t * (2 * z0 - 5 * z1 + 4 * z2 - z3 + t * (3 * (z1 - z2) + z3 - z0))))"


@query(f"""WITH g AS (SELECT i, sin(i * 0.3) AS z FROM range(21) t(i)), q AS (SELECT c_custkey, c_acctbal / 1000 + 1 AS x FROM customer),
    u AS (SELECT c_custkey, greatest(-3, least(23, x / 0.5)) AS u FROM q), k AS (SELECT c_custkey, floor(u)::INT AS k, u - floor(u) AS t FROM u),
    f AS (SELECT c_custkey, t, a.z AS z0, b.z AS z1, c.z AS z2, d.z AS z3 FROM k JOIN g a ON a.i = greatest(0, least(20, k - 1)) JOIN g b ON b.i = greatest(0, least(20, k)) JOIN g c ON c.i = greatest(0, least(20, k + 1)) JOIN g d ON d.i = greatest(0, least(20, k + 2)))
    SELECT c_custkey, round({_CATMULL}, 9) AS value FROM f""")
def cubic_interpolation(spark, sf_dir):
    f = interpolate.cubic(np.sin(np.arange(21) * 0.3), 0.0, 0.5)
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", F.round(f(F.col("c_acctbal") / 1000 + 1), 9).alias("value"))


@query(f"""WITH g AS (SELECT i, j, sin(i * 0.3) * cos(j * 0.2) AS z FROM range(11) a(i), range(11) b(j)),
    q AS (SELECT c_custkey, greatest(-3, least(13, c_acctbal / 1000 + 1)) AS u, greatest(-3, least(13, c_custkey % 100 / 8.0::DOUBLE)) AS v FROM customer),
    r AS (SELECT c_custkey, u - floor(u) AS s, v - floor(v) AS t, a, b, g.z FROM q, range(4) x(a), range(4) y(b) JOIN g ON g.i = greatest(0, least(10, floor(u)::INT + a - 1)) AND g.j = greatest(0, least(10, floor(v)::INT + b - 1))),
    rows AS (SELECT c_custkey, s, a, t, max(z) FILTER (b = 0) AS z0, max(z) FILTER (b = 1) AS z1, max(z) FILTER (b = 2) AS z2, max(z) FILTER (b = 3) AS z3 FROM r GROUP BY 1, 2, 3, 4),
    inner_ AS (SELECT c_custkey, s, a, {_CATMULL} AS z FROM rows),
    cols AS (SELECT c_custkey, s AS t, max(z) FILTER (a = 0) AS z0, max(z) FILTER (a = 1) AS z1, max(z) FILTER (a = 2) AS z2, max(z) FILTER (a = 3) AS z3 FROM inner_ GROUP BY 1, 2)
    SELECT c_custkey, round({_CATMULL}, 9) AS value FROM cols""")
def bicubic_interpolation(spark, sf_dir):
    f = interpolate.bicubic(np.sin(np.arange(11) * 0.3)[:, None] * np.cos(np.arange(11) * 0.2)[None], (0.0, 0.0), (1.0, 1.0))
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", F.round(f(F.col("c_acctbal") / 1000 + 1, F.col("c_custkey") % 100 / 8.0), 9).alias("value"))


@query(f"""WITH c AS (SELECT id, asin(z) AS dec, 0.25 - phi AS gha FROM ({CUSTOMERS}))
    SELECT id, round(0.5 * (sin(gha) * sin(gha) - cos(gha) * cos(gha)) - 0.5 * (pow(cos(gha) * sin(dec), 2) - pow(sin(gha) * sin(dec), 2)), 9) AS plus, round(2 * sin(gha) * cos(gha) * sin(dec), 9) AS "cross" FROM c""")
def antenna_response(spark, sf_dir):
    register.register(spark)
    c = _catalog(spark, sf_dir).withColumn("d", F.array(*[F.lit(float(x)) for x in np.diag([0.5, -0.5, 0.0]).ravel()]))
    f = c.select("id", F.call_function("sky_antenna_factor", "d", "ra", "dec", F.lit(0.25)).alias("f"))
    return f.select("id", F.round("f.re", 9).alias("plus"), F.round("f.im", 9).alias("cross"))


@query(f"""SELECT map_id, uniq, ord AS cell_order, ipix, uniq AS again, round(pi() / 3 * pow(0.25, ord), 12) AS area FROM (WITH {SKY} SELECT * FROM sky)""")
def registered_functions(spark, sf_dir):
    register.register(spark)
    sky_map(spark, sf_dir).createOrReplaceTempView("sky_cells")
    return spark.sql("""SELECT map_id, uniq, c.order AS cell_order, c.ipix, sky_nest2uniq(c.order, c.ipix) AS again, round(sky_uniq2pixarea(uniq), 12) AS area
        FROM (SELECT map_id, uniq, sky_uniq2nest(uniq) AS c FROM sky_cells)""")


@query(f"""WITH c AS (SELECT id, sqrt(1 - z * z) * cos(phi) AS x, sqrt(1 - z * z) * sin(phi) AS y, z FROM ({CUSTOMERS})),
    f AS (SELECT zx / sqrt(zx * zx + zy * zy + zz * zz) AS zx, zy / sqrt(zx * zx + zy * zy + zz * zz) AS zy, zz / sqrt(zx * zx + zy * zy + zz * zz) AS zz, mx, my, mz FROM (SELECT -0.3::DOUBLE AS zx, 0.5::DOUBLE AS zy, 0.1::DOUBLE AS zz, 0.85::DOUBLE AS mx, 0.35::DOUBLE AS my, 0.05::DOUBLE AS mz)),
    g AS (SELECT *, zy * mz - zz * my AS yx, zz * mx - zx * mz AS yy, zx * my - zy * mx AS yz FROM f),
    h AS (SELECT zx, zy, zz, yx / n AS yx, yy / n AS yy, yz / n AS yz FROM (SELECT *, sqrt(yx * yx + yy * yy + yz * yz) AS n FROM g))
    SELECT id, round((yy * zz - yz * zy) * x + (yz * zx - yx * zz) * y + (yx * zy - yy * zx) * z, 9) AS x, round(yx * x + yy * y + yz * z, 9) AS y, round(zx * x + zy * y + zz * z, 9) AS z FROM c, h""")
def detector_frame(spark, sf_dir):
    r = angles.detector_frame([1.0, 0.1, 0.0], [0.7, 0.6, 0.1])
    x, y, z = angles.rotate(r, *angles.to_cartesian("ra", "dec"))
    return _catalog(spark, sf_dir).select("id", F.round(x, 9).alias("x"), F.round(y, 9).alias("y"), F.round(z, 9).alias("z"))


@query(f"SELECT id, round(d * sqrt(1 - z * z) * sin(phi), 6) AS x, round(d * z, 6) AS y, round(d * sqrt(1 - z * z) * cos(phi), 6) AS z FROM (SELECT *, 100 + id % 50 AS d FROM ({CUSTOMERS}))")
def rotate_samples(spark, sf_dir):
    c = _catalog(spark, sf_dir).withColumn("distance", 100 + F.col("id") % 50)
    r = image.rotate_samples(c, [[0, 1, 0], [0, 0, 1], [1, 0, 0]])
    return r.select("id", *[F.round(a, 6).alias(a) for a in "xyz"])


# --- maps with distance


@query(f"""WITH RECURSIVE {geo.DMAP}, hit AS (SELECT * FROM {geo.lookup("(SELECT s_suppkey AS id, (s_suppkey % 628 / 100.0)::DOUBLE AS phi, sin((s_suppkey % 300 / 100.0 - 1.5)::DOUBLE) AS z FROM supplier)", 1)})
    SELECT id, r, round({geo.ansatz_pdf('r')} * 1e4, 8) AS pdf FROM hit JOIN dmap ON ipix = p, (SELECT (1500 * i)::DOUBLE AS r FROM range(1, 7) t(i))""")
def distance_curves(spark, sf_dir):
    c = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 628 / 100.0).alias("ra"), (F.col("s_suppkey") % 300 / 100.0 - 1.5).alias("dec"))
    d = image.distance_curves(_distance_map(spark, sf_dir), crossmatch.catalog_points(c), [1500.0 * k for k in range(1, 7)])
    return d.select("id", "r", F.round(F.col("pdf") * 1e4, 8).alias("pdf"))


@query(f"""WITH RECURSIVE {geo.DMOM}, c AS (SELECT p, z, sqrt(1 - z * z) * cos(phi) AS x, sqrt(1 - z * z) * sin(phi) AS y FROM {geo.cells('(SELECT 1 AS k, p FROM range(48) r(p))')}),
    s AS (SELECT sum(m * x * x) AS xx, sum(m * x * y) AS xy, sum(m * x * z) AS xz, sum(m * y * y) AS yy, sum(m * y * z) AS yz, sum(m * z * z) AS zz FROM (SELECT x, y, z, prob * (std * std + mean * mean) AS m FROM dmom JOIN c ON p = ipix))
    SELECT round((xx + yy + zz) / 1e6, 6) AS trace, round((xx * yy + yy * zz + zz * xx - xy * xy - yz * yz - xz * xz) / 1e12, 6) AS minors, round((xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz)) / 1e18, 6) AS det, 1 AS right_handed FROM s""")
def principal_moments(spark, sf_dir):
    """The invariants of the second moments, from the principal axes and the moments along them."""
    from ..functions import distance as D
    from ..operators import moments

    m = _distance_map(spark, sf_dir)
    axes = moments.principal_axes(m)
    order, ipix = ix.uniq2nest("uniq")
    v = m.withColumn("v", ix.nest2vec(order, ipix)).withColumn("q", D.to_moments("distmu", "distsigma")).withColumn("mass", F.col("prob") * (F.col("q.diststd") ** 2 + F.col("q.distmean") ** 2))
    along = v.crossJoin(F.broadcast(axes)).select("mass", *[(F.col("v.x") * F.col("axes")[0][k] + F.col("v.y") * F.col("axes")[1][k] + F.col("v.z") * F.col("axes")[2][k]).alias(f"a{k}") for k in range(3)])
    e = along.agg(*[F.sum(F.col("mass") * F.col(f"a{k}") ** 2).alias(f"e{k}") for k in range(3)])
    a = lambda i, j: F.col("axes")[i][j]
    det = a(0, 0) * (a(1, 1) * a(2, 2) - a(1, 2) * a(2, 1)) - a(0, 1) * (a(1, 0) * a(2, 2) - a(1, 2) * a(2, 0)) + a(0, 2) * (a(1, 0) * a(2, 1) - a(1, 1) * a(2, 0))
    e = e.crossJoin(F.broadcast(axes))
    return e.select(F.round((F.col("e0") + F.col("e1") + F.col("e2")) / 1e6, 6).alias("trace"), F.round((F.col("e0") * F.col("e1") + F.col("e1") * F.col("e2") + F.col("e2") * F.col("e0")) / 1e12, 6).alias("minors"), F.round(F.col("e0") * F.col("e1") * F.col("e2") / 1e18, 6).alias("det"), F.round(det).cast("int").alias("right_handed"))


_ALL14 = f"""WITH RECURSIVE {VOXELS.replace("{far}", _FAR)}, {DISTANCES}, {FOUND},
    centre AS (SELECT p, z, phi FROM {geo.cells('(SELECT 1 AS k, p FROM range(48) r(p))')}),
    flat AS (SELECT ipix, prob, prob / (pi() / 12) AS density, sum(prob) OVER w AS cum_p, count(*) OVER w AS nth, 41252.96124941928 / 48 AS a FROM dmap WINDOW w AS (ORDER BY prob DESC, ipix ROWS UNBOUNDED PRECEDING)),
    {_modes_sql('SELECT n.nth AS map_id, m.ipix FROM flat m, flat n WHERE m.nth <= n.nth', 1, '_m')}, best AS (SELECT z AS bz, phi AS bphi FROM flat JOIN centre ON p = ipix WHERE nth = 1),
    one AS (SELECT CASE WHEN max(cum_p) < 0.5 THEN 41252.96124941928 ELSE min_by((nth - 1 + (0.5 - cum_p + prob) / prob) * a, nth) FILTER (cum_p >= 0.5) END AS area_50, CASE WHEN max(cum_p) < 0.9 THEN 41252.96124941928 ELSE min_by((nth - 1 + (0.9 - cum_p + prob) / prob) * a, nth) FILTER (cum_p >= 0.9) END AS area_90,
        max(prob / a * 100) FILTER (nth = 1) AS prob_100, count(*) FILTER (cum_p <= 0.5) AS n_50, count(*) FILTER (cum_p <= 0.9) AS n_90 FROM flat),
    ends AS (SELECT x, min((a.i + (x - a.p) / (b.p - a.p)) * d) AS r FROM (SELECT unnest([0.25::DOUBLE, 0.75, 0.05, 0.95]) AS x), reach, grid a JOIN grid b ON b.i = a.i + 1 WHERE a.p < x AND b.p >= x GROUP BY x),
    vols AS (SELECT l, min_by(cum_v - dv + (l - cum_p + dp) * dv / dp, cum_p) AS v FROM run, (SELECT unnest([0.5::DOUBLE, 0.9]) AS l) WHERE cum_p >= l AND dp > 0 GROUP BY l)
    SELECT f.id, round(nth * a, 6) AS searched_area, round(flat.cum_p, 9) AS searched_prob, round(degrees(acos(greatest(-1, least(1, z * bz + sqrt(1 - z * z) * sqrt(1 - bz * bz) * cos(phi - bphi))))), 6) AS "offset", modes AS searched_modes,
        round(area_50, 6) AS area_50, round(area_90, 6) AS area_90, round(prob_100, 9) AS prob_100, coalesce((SELECT modes FROM modes_m WHERE map_id = n_50), 0) AS modes_50, coalesce((SELECT modes FROM modes_m WHERE map_id = n_90), 0) AS modes_90,
        round(along, 7) AS searched_prob_dist, round((SELECT r FROM ends WHERE x = 0.75) - (SELECT r FROM ends WHERE x = 0.25), 4) AS dist_50, round((SELECT r FROM ends WHERE x = 0.95) - (SELECT r FROM ends WHERE x = 0.05), 4) AS dist_90,
        round(cum_v / 1e9, 3) AS searched_vol, round(space.cum_p, 7) AS searched_prob_vol, round((SELECT v FROM vols WHERE l = 0.5) / 1e9, 3) AS vol_50, round((SELECT v FROM vols WHERE l = 0.9) / 1e9, 3) AS vol_90, round(density, 9) AS probdensity, round(rate * 1e12, 5) AS probdensity_vol
    FROM found f JOIN space USING (id) JOIN flat ON flat.ipix = f.ipix JOIN modes_m ON map_id = nth, one, best"""


@query(_ALL14)
def crossmatch_all(spark, sf_dir):
    r = crossmatch.crossmatch(_distance_map(spark, sf_dir).drop("prob"), _suppliers(spark, sf_dir), modes=True)
    digits = {"searched_area": 6, "searched_prob": 9, "offset": 6, "searched_prob_dist": 7, "searched_prob_vol": 7, "probdensity": 9}
    pairs = [F.round(F.col(c)[k] / by, d).alias(f"{name}_{level}") for c, name, d, by in (("contour_areas", "area", 6, 1), ("contour_dists", "dist", 4, 1), ("contour_vols", "vol", 3, 1e9)) for k, level in enumerate((50, 90))]
    pairs += [F.col("contour_modes")[k].alias(f"modes_{level}") for k, level in enumerate((50, 90))]
    own = [F.round(F.col("searched_vol") / 1e9, 3).alias("searched_vol"), F.round(F.col("probdensity_vol") * 1e12, 5).alias("probdensity_vol"), F.round(F.col("area_probs")[0], 9).alias("prob_100")]
    return r.select("id", "searched_modes", *[F.round(c, d).alias(c) for c, d in digits.items()], *pairs, *own)


@query(f"""WITH RECURSIVE {GREEDY}, hit AS (SELECT id, p FROM {geo.lookup(f"({CUSTOMERS})", 3)}), corner AS {geo.corners(3)}, near AS (SELECT DISTINCT a.p AS a, b.p AS b FROM corner a JOIN corner b ON a.key = b.key),
    turn AS (SELECT map_id, uniq, ord, ipix, row_number() OVER (PARTITION BY map_id ORDER BY dens DESC, uniq) AS nth FROM c),
    part AS (SELECT map_id, nth, CASE ord WHEN 2 THEN 4 * ipix + j ELSE ipix END AS q FROM turn, range(4) r(j) WHERE ord = 2 OR j = 0),
    touch AS (SELECT DISTINCT x.map_id, x.nth AS a, y.nth AS b FROM part x JOIN near ON near.a = x.q JOIN part y ON y.q = near.b AND y.map_id = x.map_id WHERE x.nth <> y.nth),
    label(map_id, upto, nth, root) USING KEY (map_id, upto, nth) AS (
        SELECT m.map_id, k.nth, m.nth, m.nth FROM turn m JOIN turn k ON k.map_id = m.map_id AND m.nth <= k.nth
        UNION SELECT l.map_id, l.upto, t.b, min(l.root) FROM label l JOIN touch t ON t.map_id = l.map_id AND t.a = l.nth JOIN recurring.label r ON r.map_id = l.map_id AND r.upto = l.upto AND r.nth = t.b
            WHERE t.b <= l.upto AND l.root < r.root GROUP BY ALL),
    modes AS (SELECT map_id, upto, count(*) FILTER (nth = root) AS modes FROM label GROUP BY 1, 2)
    SELECT h.id, m.map_id, modes FROM hit h JOIN part x ON x.q = h.p JOIN modes m ON m.map_id = x.map_id AND m.upto = x.nth""")
def searched_modes(spark, sf_dir):
    """Modes of the region that each target closes, of four maps: one running sum a map, whatever the number of targets."""
    m = modes.with_steps(_density_map(spark, sf_dir), ["map_id"])
    c = cumulative_by_range(m, ["map_id"], [F.desc("probdensity"), F.col("uniq")], {"modes": F.col("modes_step")})
    hit = crossmatch.locate(crossmatch.catalog_points(_catalog(spark, sf_dir), z="sine"), c.select("map_id", "uniq", F.col("modes").cast("long").alias("modes")))
    return hit.select("id", "map_id", "modes")


# --- series and densities


PP = "SELECT o_orderstatus AS s, (o_orderkey * 7919 % 10007) / 10007.0::DOUBLE AS p FROM orders"


@query(f"""WITH r AS (SELECT s, p, row_number() OVER (PARTITION BY s ORDER BY p) / count(*) OVER (PARTITION BY s) AS f FROM ({PP})),
    e AS (SELECT * FROM r UNION ALL SELECT DISTINCT s, 0, 0 FROM r UNION ALL SELECT DISTINCT s, 1, 1 FROM r) SELECT s, round(max(abs(f - p)), 9) AS deviation FROM e GROUP BY 1""")
def pp_worst(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("s"), (F.col("o_orderkey") * 7919 % 10007 / 10007.0).alias("p"))
    return stats.pp_worst(stats.pp_series(o, "p", ["s"]), ["s"]).select("s", F.round("deviation", 9).alias("deviation"))


@query("SELECT event_type, share, round(q, 6) AS value FROM (SELECT event_type, unnest([0.0::DOUBLE, 0.25, 0.5, 0.75, 1.0]) AS share, unnest(quantile_cont(value, [0.0, 0.25, 0.5, 0.75, 1.0])) AS q FROM events GROUP BY event_type)")
def empirical_quantiles(spark, sf_dir):
    return stats.empirical_quantiles(table(spark, sf_dir, "events"), "value", 5, ["event_type"]).select("event_type", "share", F.round("value", 6).alias("value"))


@query("""WITH d AS (SELECT curve, ('0x' || sha256('5:' || curve || ':' || o_orderkey)[1:12])::BIGINT / pow(16, 12)::DOUBLE AS p FROM orders, range(3) t(curve)),
    r AS (SELECT curve, p, row_number() OVER (PARTITION BY curve ORDER BY p) / count(*) OVER (PARTITION BY curve) AS f FROM d UNION ALL SELECT curve, e, e FROM range(3) t(curve), (SELECT unnest([0.0::DOUBLE, 1.0]) AS e))
    SELECT curve::INT AS curve, count(*) AS n, round(sum(p), 6) AS p, round(sum(abs(f - p)), 6) AS apart, round(max(abs(f - p)), 9) AS worst FROM r GROUP BY 1""")
def pp_lightning(spark, sf_dir):
    s = stats.pp_lightning(table(spark, sf_dir, "orders"), "o_orderkey", 3, 5)
    far = F.abs(F.col("fraction") - F.col("p"))
    return s.groupBy("curve").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("p"), 6).alias("p"), F.round(F.sum(far), 6).alias("apart"), F.round(F.max(far), 9).alias("worst"))


@query("""WITH v AS (SELECT CAST(embedding[1] AS DOUBLE) AS x FROM embeddings), s AS (SELECT count(*) AS n, stddev_samp(x) * pow(count(*), -0.2) AS h FROM v)
    SELECT i::INT AS k, round(sum(exp(-0.5 * pow((q - x) / h, 2)) + exp(-0.5 * pow((-2 - q - x) / h, 2)) + exp(-0.5 * pow((2 - q - x) / h, 2))) / max(n) / max(h) / sqrt(2 * pi()), 8) AS density
    FROM v, s, (SELECT i, -1 + i / 10.0::DOUBLE AS q FROM range(21) t(i)) GROUP BY i""")
def bounded_density(spark, sf_dir):
    points = np.array(table(spark, sf_dir, "embeddings").select(F.element_at("embedding", 1).cast("double")).toArrow().column(0).to_pylist())
    kde = density.BoundedKDE(points[:, None], -1.0, 1.0)

    @vectorized("double")
    def at(q: pd.Series) -> pd.Series:
        return pd.Series(kde(q.to_numpy(float)[:, None]))

    return spark.range(21).select(F.col("id").cast("int").alias("k"), F.round(at(F.lit(-1.0) + F.col("id") / 10.0), 8).alias("density"))


# --- events


@query("SELECT count(*) AS n, count(DISTINCT o_orderkey) AS different, min(1) AS found FROM (SELECT DISTINCT o_orderkey FROM orders LIMIT 300)")
def subsample(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey").distinct()
    some = events.subsample(o, 300, 7, "o_orderkey")
    return some.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("different"), F.lit(1).alias("found"))


@query("SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal BETWEEN 1000 AND 6000")
def between_distances(spark, sf_dir):
    return events.between_distances(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), 1000.0, 6000.0, "s_acctbal")


@query("SELECT c_custkey, c_acctbal FROM customer")
def exactly_one(spark, sf_dir):
    return events.exactly_one(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), ["c_custkey"])


@query("SELECT l_linenumber, l_quantity, round(CASE l_linenumber % 3 WHEN 0 THEN l_extendedprice - 0.5 * l_quantity WHEN 1 THEN l_extendedprice + 0.5 * l_quantity ELSE l_extendedprice END, 4) AS moved FROM lineitem")
def half_slide(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_linenumber", "l_quantity", F.round(events.half_slide(F.col("l_linenumber") % 3, F.col("l_extendedprice"), F.col("l_quantity")), 4).alias("moved"))


_TRIGGERS = "SELECT l_returnflag AS ifo, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_quantity, l_shipdate) - 1 AS row, l_quantity AS snr, l_discount AS coa_phase, epoch_us(l_shipdate) / 1000000 AS end_time FROM lineitem"


@query(f"""WITH t AS ({_TRIGGERS}), size AS (SELECT ifo, count(*) AS rows FROM t GROUP BY 1), bank AS (SELECT count(*) AS templates FROM (SELECT DISTINCT p_partkey FROM part)),
    c AS (SELECT DISTINCT o_orderkey AS coinc_id, o_orderkey % templates AS template_id, o_orderkey % 3 AS slide FROM orders, bank),
    s AS (SELECT coinc_id, template_id, i, t.ifo, CASE i WHEN 0 THEN end_time - 0.5 * slide * 0.1 WHEN 1 THEN end_time + 0.5 * slide * 0.1 END AS time, snr, floor(end_time / 5000000)::BIGINT AS segment
        FROM c, (VALUES (0, 'A', 3), (1, 'N', 5)) d(i, flag, step) JOIN size ON size.ifo = flag JOIN t ON t.ifo = flag AND t.row = (coinc_id * step) % rows)
    SELECT coinc_id, template_id, p_size AS mass1, count(*)::INT AS n, round(sum(snr), 4) AS snr, round(sum(time - 8e8), 3) AS times, sum(segment)::BIGINT AS segments FROM s JOIN (SELECT p_size, row_number() OVER (ORDER BY p_partkey) - 1 AS nth FROM part) ON nth = template_id GROUP BY 1, 2, 3""")
def hdf_events(spark, sf_dir):
    """Coincidences by row numbers in all triggers of each detector and all templates, with their template and spectrum segment."""
    li = table(spark, sf_dir, "lineitem")
    by = [F.asc(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_shipdate")]
    numbered = cumulative_by_range(li, ["l_returnflag"], by, {"_nth": F.lit(1)})
    triggers = numbered.select(F.col("l_returnflag").alias("ifo"), (F.col("_nth") - 1).cast("long").alias("row"), F.col("l_quantity").alias("snr"), F.col("l_discount").alias("coa_phase"), (F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 1000000).alias("end_time"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("coinc_id")).distinct()
    sizes = {r[0]: r[1] for r in triggers.groupBy("ifo").count().collect()}  # a row for each detector
    refs = F.array(*[F.struct(F.lit(f).alias("ifo"), (F.col("coinc_id") * k % sizes.get(f, 1)).alias("row")) for f, k in (("A", 3), ("N", 5))])
    part = cumulative_by_range(table(spark, sf_dir, "part"), [], [F.asc("p_partkey")], {"_nth": F.lit(1)})
    bank = part.select((F.col("_nth") - 1).cast("long").alias("template"), F.col("p_size").alias("mass1"))
    templates = max(1, bank.count())
    coincs = o.select("coinc_id", (F.col("coinc_id") % templates).alias("template_id"), (F.col("coinc_id") % 3).alias("timeslide_id"), F.lit(0.1).alias("shift"), refs.alias("trigger_ids"))
    low, high = triggers.agg(F.floor(F.min("end_time") / 5e6), F.floor(F.max("end_time") / 5e6)).first()
    psds = triggers.select("ifo").distinct().select("ifo", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("segment")).select("ifo", (F.col("segment") * 5e6).alias("start"), ((F.col("segment") + 1) * 5e6).alias("end"), "segment")
    found = tables.hdf_tables([coincs, bank.withColumn("mass2", F.lit(1.0)), triggers, psds])
    e = events.hdf_events(found["coincs"], found["triggers"][0], found["bank"].drop("mass2"), found["psds"][0])
    total = lambda f: F.aggregate("singles", F.lit(0.0), lambda a, s: a + f(s))
    return e.select("coinc_id", "template_id", "mass1", F.size("singles").alias("n"), F.round(total(lambda s: s["snr"]), 4).alias("snr"), F.round(total(lambda s: s["time"] - 8e8), 3).alias("times"), total(lambda s: s["segment"].cast("double")).cast("long").alias("segments"))


_DOCUMENTS = """SELECT o_orderkey AS id, min(o_custkey) AS proc, min(o_orderkey % 3) AS slide FROM orders GROUP BY 1"""


#: Orders in a document, about; there are four documents at least.
PER_DOCUMENT = 20_000


def _write_documents(spark, sf_dir, folder: str) -> None:
    """Documents whose number grows with the data: orders as coincidences, lines as triggers, customers as processes, statuses as slides."""
    documents = max(4, -(-table(spark, sf_dir, "orders").count() // PER_DOCUMENT))
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderkey").alias("coinc_event_id")).agg(F.min("o_custkey").alias("process_id"), F.min(F.col("o_orderkey") % 3).alias("time_slide_id"))
    o = o.withColumn("coinc_def_id", F.col("coinc_event_id") % 2).withColumn("doc", F.pmod(F.xxhash64("coinc_event_id"), F.lit(documents)))
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("coinc_event_id"), F.col("l_returnflag").alias("ifo")).agg(F.max("l_quantity").alias("snr"), F.max("l_discount").alias("coa_phase"), F.min("l_extendedprice").alias("end"))
    li = li.join(o.select("coinc_event_id", "process_id", "doc"), "coinc_event_id").withColumn("event_id", F.col("coinc_event_id") * 3 + F.when(F.col("ifo") == "A", 0).when(F.col("ifo") == "N", 1).otherwise(2))
    process = o.select("process_id", "doc", F.when(F.col("process_id") % 2 == 0, "pycbc").otherwise("gstlal_inspiral").alias("program")).distinct()
    slides = o.select("time_slide_id", "doc").distinct().select("time_slide_id", "doc", F.explode(F.array(*map(F.lit, "ANR"))).alias("instrument")).withColumn("offset", F.col("time_slide_id") * 0.25)
    definer = o.select("coinc_def_id", "doc").distinct().withColumn("search", F.when(F.col("coinc_def_id") == 0, "inspiral").otherwise("other")).withColumn("search_coinc_type", F.lit(0))
    written = tables.write_ligolw({
        "coinc_event": o, "coinc_event_map": li.select("coinc_event_id", "event_id", "doc", F.lit("sngl_inspiral").alias("table_name")),
        "sngl_inspiral": li.select("event_id", "process_id", "ifo", "snr", "coa_phase", "end", "doc"), "process": process, "time_slide": slides, "coinc_definer": definer,
    }, "doc", _local(folder))
    written.collect()


@query(f"""WITH o AS ({_DOCUMENTS}), s AS (SELECT l_orderkey AS id, l_returnflag AS ifo, max(l_quantity) AS snr, max(l_discount) AS phase, min(l_extendedprice) AS "end" FROM lineitem GROUP BY 1, 2)
    SELECT id AS coinc_event_id, count(*)::INT AS n, round(sum(CASE WHEN proc % 2 = 0 THEN phase ELSE -phase END), 6) AS phase, round(sum("end" + slide * 0.25), 4) AS time, round(sum("end"), 4) AS zerolag, round(sum(snr), 4) AS snr
    FROM o JOIN s USING (id) WHERE id % 2 = 0 GROUP BY 1""")
def event_documents(spark, sf_dir):
    """Documents written and read again: triggers with offsets and phase conventions, of one definition."""
    folder = _folder(spark, "events")
    _write_documents(spark, sf_dir, folder)
    e = tables.open_events(spark, folder).rows
    total = lambda f: F.aggregate("singles", F.lit(0.0), lambda a, s: a + s[f])
    return e.select("coinc_event_id", F.size("singles").alias("n"), *[F.round(total(f), d).alias(n) for f, d, n in (("phase", 6, "phase"), ("time", 4, "time"), ("zerolag_time", 4, "zerolag"), ("snr", 4, "snr"))])


# --- sources and sinks


@query(f"WITH {SKY}, a AS (SELECT *, sum(w) OVER (PARTITION BY map_id) AS all_w FROM sky) SELECT map_id::VARCHAR AS map_id, uniq, round(w / all_w / (pi() / 3 * pow(0.25, ord)), 9) AS probdensity FROM a")
def fits_roundtrip(spark, sf_dir):
    folder = _folder(spark, "maps")
    fits.write_maps(_density_map(spark, sf_dir), _local(folder), "map_id", {"objid": 7}).collect()
    m = fits.read_maps(spark, f"{folder}/*.fits")
    return m.select(F.regexp_extract("path", r"([^/]+)\.fits$", 1).alias("map_id"), "uniq", F.round("probdensity", 9).alias("probdensity"))


@query("SELECT map_id::VARCHAR AS map_id, '7' AS objid, '1126259462.391' AS gps_time, '2.5' AS log_bci, '57279.41' AS mjd FROM range(4) t(map_id)")
def fits_metadata(spark, sf_dir):
    folder = _folder(spark, "cards")
    meta = {"objid": "event:event_id:7", "gps_time": 1126259462.391, "log_bci": 2.5, "instruments": {"L1", "H1"}}
    fits.write_maps(_density_map(spark, sf_dir), _local(folder), "map_id", meta).collect()
    m = fits.read_metadata(spark, f"{folder}/*.fits")
    return m.select(F.regexp_extract("path", r"([^/]+)\.fits$", 1).alias("map_id"), "objid", "gps_time", "log_bci", F.round(gps.gps_to_mjd(F.col("gps_time").cast("double")), 2).cast("string").alias("mjd"))


@query(f"WITH {GREEDY} SELECT map_id::VARCHAR AS map_id, sum(units)::BIGINT AS units FROM c WHERE (cum_w - w) / all_w < 0.9 GROUP BY 1")
def moc_region(spark, sf_dir):
    folder = _folder(spark, "mocs")
    region = credible.region(_ranked(spark, sf_dir), "w", 0.9, ["map_id"], F.col("dens"))
    fits.write_moc(region, _local(folder), "map_id").collect()
    m = fits.read_maps(spark, f"{folder}/*.fits", ())
    units = F.call_function("shiftleft", F.lit(1).cast("long"), (2 * (3 - ix.uniq2order("uniq"))).cast("int"))
    return m.select(F.regexp_extract("path", r"([^/]+)\.moc\.fits$", 1).alias("map_id"), units.alias("units")).groupBy("map_id").agg(F.sum("units").alias("units"))


@query("SELECT (c_custkey % 628 / 100.0)::DOUBLE AS ra, (c_custkey % 300 / 100.0 - 1.5)::DOUBLE AS \"dec\", round(abs(c_acctbal) + 1, 2) AS distance, 1.4::DOUBLE AS mass1 FROM customer")
def samples_roundtrip(spark, sf_dir):
    """A chain with aliased names and a column of one value, through Parquet and the aliases."""
    folder = _folder(spark, "chain")
    c = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 628 / 100.0).alias("right_ascension"), (F.col("c_custkey") % 300 / 100.0 - 1.5).alias("declination"), F.log(F.abs("c_acctbal") + 1).alias("logdistance"), F.lit(1.4).alias("m1"))
    fixed = tables.write_samples(c, f"{folder}/run/posterior_samples.parquet")
    s = tables.read_samples(spark, tables.find_table(spark, folder), fixed)
    return s.select("ra", "dec", F.round("distance", 2).alias("distance"), "mass1")


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def tsv_roundtrip(spark, sf_dir):
    folder = _folder(spark, "stats")
    tables.write_tsv(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal"), folder)
    return spark.read.option("sep", "\t").option("header", True).schema("s_suppkey long, s_name string, s_acctbal double").csv(folder)


@query("SELECT n_name AS line FROM nation")
def lines_roundtrip(spark, sf_dir):
    folder = _folder(spark, "lines")
    table(spark, sf_dir, "nation").select(F.concat(F.lit("  "), F.col("n_name"), F.lit(" \n")).alias("value")).write.text(folder)
    return tables.read_lines(spark, folder)


# --- a map that grows with the data


def _large_map(spark, sf_dir, lines=None):
    """(uniq, w): lines of orders, by default all, as the cells of one map at order 9, 3,145,728 cells at most."""
    li = table(spark, sf_dir, "lineitem") if lines is None else lines
    return li.groupBy((F.shiftright(line_pixels(), 40) + 4**10).alias("uniq")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("w"))


_LARGE = "large AS (SELECT ((((l_orderkey * 1000003 + l_partkey * 10007) * 1299709) % 3458764513820540928) >> 40) + 1048576 AS uniq, sum(CAST(round(l_extendedprice * 100) AS BIGINT))::BIGINT AS w FROM lineitem GROUP BY 1)"


@query(f"WITH {_LARGE}, c AS (SELECT *, sum(w) OVER (ORDER BY w DESC, uniq ROWS UNBOUNDED PRECEDING) AS upto, sum(w) OVER () AS total FROM large) SELECT uniq, w, (upto / total)::DOUBLE AS cls FROM c")
def large_map_levels(spark, sf_dir):
    """Levels of one map too large for a task: sums by range."""
    return credible.greedy_levels(_large_map(spark, sf_dir), "w").select("uniq", "w", "cls")


@query(f"WITH {_LARGE}, c AS (SELECT (l_orderkey * 7 + l_linenumber) % 3145728 AS p FROM lineitem) SELECT count(*) AS n, sum(w)::BIGINT AS w FROM c JOIN large ON uniq = p + 1048576")
def large_map_locate(spark, sf_dir):
    """Points in the cells of that map."""
    key, line, n = F.col("l_orderkey"), F.col("l_linenumber"), 3145728
    rest = F.pmod(F.pmod(key, F.lit(n)) * 7 + line, F.lit(n))  # seven times a key may leave 64 bits
    pixel = F.when((key < -line / 7) & (rest > 0), rest - n).otherwise(rest)
    points = table(spark, sf_dir, "lineitem").select(F.shiftleft(pixel, 40).alias("p29"))
    return crossmatch.locate(points, _large_map(spark, sf_dir)).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"))


@query()
def large_map_modes(spark, sf_dir):
    """Modes of the credible regions of that map; the merge tree is tested by brute force, as labels take SQL minutes here."""
    lines = table(spark, sf_dir, "lineitem").dropna(subset=["l_orderkey", "l_partkey"])  # others have no pixel
    m = _large_map(spark, sf_dir, lines)
    total = m.agg(F.sum("w")).first()[0] or 1
    return crossmatch.contour_modes(m.select("uniq", (F.col("w") / total / ix.uniq2pixarea("uniq")).alias("probdensity")), [0.5, 0.9])
