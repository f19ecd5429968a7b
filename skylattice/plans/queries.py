"""Queries over the fixtures, one for each operator, with their SQL for the oracle."""

from __future__ import annotations


import numpy as np
from pyspark.sql import functions as F

from ..functions import angles, cosmology, distance, gps, register, signal
from ..functions import index as ix
from ..operators import contours, credible, crossmatch, density, events, image, localize, maps, moments, simulate, stats, visibility
from ..streaming import windows
from . import geometry_sql as geo
from .fixtures import FLAT, POINTS, SKY, cents, distances, flat_map, line_pixels, points, sky_map, table, triggers

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    """Register a function under its name; without SQL only rows are checked."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


AREA3 = "(CASE ord WHEN 2 THEN 4 ELSE 1 END)"  # of a cell, in pixels of order 3


def _units(df):
    """Cells with their area in pixels of order 3, an integer."""
    order, _ = ix.uniq2nest("uniq")
    return df.withColumn("units", F.call_function("shiftleft", F.lit(1).cast("long"), (2 * (3 - order)).cast("int")))


# --- index arithmetic


@query(f"WITH {SKY} SELECT map_id, uniq, ord AS cell_order, ipix, ipix // 4 AS parent, uniq AS again FROM sky")
def index_roundtrip(spark, sf_dir):
    order, ipix = ix.uniq2nest("uniq")
    m = sky_map(spark, sf_dir).withColumn("cell_order", order).withColumn("ipix", ipix)
    return m.select("map_id", "uniq", "cell_order", "ipix", ix.ancestor("ipix", 1).alias("parent"), ix.nest2uniq("cell_order", "ipix").alias("again"))


@query(f"WITH {SKY} SELECT map_id, ord AS cell_order, count(*) AS n, sum(CASE ord WHEN 2 THEN 4 ELSE 1 END)::BIGINT AS units FROM sky GROUP BY 1, 2")
def cells_by_order(spark, sf_dir):
    m = _units(sky_map(spark, sf_dir)).withColumn("cell_order", ix.uniq2order("uniq"))
    return m.groupBy("map_id", "cell_order").agg(F.count(F.lit(1)).alias("n"), F.sum("units").alias("units"))


@query(f"WITH {SKY} SELECT map_id, uniq, round(pi() / 3 * pow(0.25, ord), 12) AS area FROM sky")
def pixel_area(spark, sf_dir):
    return sky_map(spark, sf_dir).select("map_id", "uniq", F.round(ix.uniq2pixarea("uniq"), 12).alias("area"))


@query(f"WITH {FLAT} SELECT map_id, (4 * ipix + c)::BIGINT AS ipix, w FROM flat, range(4) t(c)")
def descendants(spark, sf_dir):
    f = flat_map(spark, sf_dir)
    return f.select("map_id", F.explode(ix.children(F.col("ipix"))).alias("ipix"), "w")


# --- resampling


@query(f"WITH {SKY} SELECT map_id, ipix * 4 + c AS ipix, w FROM sky, range(4) t(c) WHERE ord = 2 UNION ALL SELECT map_id, ipix, w FROM sky WHERE ord = 3")
def rasterize_up(spark, sf_dir):
    return maps.rasterize(sky_map(spark, sf_dir), 3, ["map_id"])


@query(f"""WITH {SKY} SELECT map_id, ipix // pow(4, ord - 1)::BIGINT AS ipix, round(sum(w * pow(0.25, ord - 1)), 4) AS w
    FROM sky GROUP BY 1, 2""")
def rasterize_down(spark, sf_dir):
    m = sky_map(spark, sf_dir).withColumn("w", F.col("w").cast("double"))
    return maps.rasterize(m, 1, ["map_id"]).select("map_id", "ipix", F.round("w", 4).alias("w"))


MERGED = f"""{FLAT}, q AS (SELECT map_id, ipix, (w > 400000000)::INT AS v FROM flat),
    p1 AS (SELECT map_id, ipix // 4 AS ipix, min(v) AS v, min(v) = max(v) AS same FROM q GROUP BY 1, 2),
    p0 AS (SELECT map_id, ipix // 4 AS ipix, min(v) AS v, bool_and(same) AND min(v) = max(v) AS same FROM p1 GROUP BY 1, 2),
    merged AS (SELECT map_id, ipix + 4 AS uniq, v, 0 AS k FROM p0 WHERE same
        UNION ALL SELECT p1.map_id, p1.ipix + 16, p1.v, 1 FROM p1 JOIN p0 ON p1.map_id = p0.map_id AND p1.ipix // 4 = p0.ipix WHERE p1.same AND NOT p0.same
        UNION ALL SELECT q.map_id, q.ipix + 64, q.v, 2 FROM q JOIN p1 ON q.map_id = p1.map_id AND q.ipix // 4 = p1.ipix WHERE NOT p1.same)"""


@query(f"WITH {MERGED} SELECT map_id, uniq, v FROM merged")
def derasterize(spark, sf_dir):
    f = flat_map(spark, sf_dir).select("map_id", "ipix", (F.col("w") > 400000000).cast("int").alias("v"))
    return maps.derasterize(f, 2, ["map_id"])


@query(f"""WITH {MERGED}, leaf AS (SELECT map_id, v, k::INT AS "order", uniq - pow(4, k + 1)::BIGINT AS ipix, pow(2, k)::BIGINT AS nside FROM merged)
    SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY ipix * pow(4, 2 - "order")) AS rank FROM leaf""")
def reconstruct_tree(spark, sf_dir):
    f = flat_map(spark, sf_dir).select("map_id", "ipix", (F.col("w") > 400000000).cast("int").alias("v"))
    return maps.reconstruct(f, 2, ["map_id"])


@query(f"WITH {FLAT} SELECT map_id, ipix // 4 AS ipix, (sum(w) / 4.0 * 4)::DOUBLE AS w FROM flat GROUP BY 1, 2")
def ud_grade_sum(spark, sf_dir):
    f = flat_map(spark, sf_dir).withColumn("w", F.col("w").cast("double"))
    return maps.ud_grade(f, 2, 1, ["map_id"], power=-2)


@query(f"""WITH {FLAT}, p AS (SELECT ipix, max(w) FILTER (map_id = 0)::DOUBLE * max(w) FILTER (map_id = 1) AS p FROM flat GROUP BY 1)
    SELECT ipix, round(p / sum(p) OVER () / (4 * pi() / 192), 9) AS probdensity FROM p""")
def combine_maps(spark, sf_dir):
    f = flat_map(spark, sf_dir).select("map_id", ix.nest2uniq(F.lit(2), F.col("ipix")).alias("uniq"), F.col("w").cast("double").alias("probdensity"))
    a, b = (f.where(F.col("map_id") == k).drop("map_id") for k in (0, 1))
    return maps.combine(a, b).select("ipix", F.round("probdensity", 9).alias("probdensity"))


HISTOGRAM = f"""{POINTS}, t AS (
    SELECT 0 AS k, b.i AS ipix, count(p.p29) AS n FROM range(12) b(i) LEFT JOIN points p ON (p.p29 >> 58) = b.i GROUP BY b.i
    UNION ALL
    SELECT k, ipix, n FROM (
        SELECT t.k + 1 AS k, t.ipix * 4 + c AS ipix, (SELECT count(*) FROM points p WHERE (p.p29 >> (2 * (29 - t.k - 1))) = t.ipix * 4 + c) AS n
        FROM t, range(4) s(c) WHERE t.n >= 1500 AND t.k < 29)), leaf AS (SELECT * FROM t WHERE n < 1500)"""


@query(f"WITH RECURSIVE {HISTOGRAM} SELECT ipix + (1::BIGINT << (2 * (k + 1))) AS uniq, n FROM leaf")
def adaptive_histogram(spark, sf_dir):
    return maps.adaptive_histogram(points(spark, sf_dir), 1500).select("uniq", "n")


@query(f"""WITH RECURSIVE {HISTOGRAM}, top AS (SELECT max(k) AS m FROM leaf), held AS (SELECT k, ipix, n, coalesce(sum(p29 % 1000003), 0)::BIGINT AS total FROM leaf LEFT JOIN points ON (p29 >> (2 * (29 - k))) = ipix GROUP BY ALL)
    SELECT row_number() OVER (ORDER BY ipix << (2 * (29 - k))) AS depth, row_number() OVER (ORDER BY k, ipix) AS breadth, 1::BIGINT << k AS nside, 1::BIGINT << m AS full_nside, ipix, ipix << (2 * (m - k)) AS ipix0, (ipix + 1) << (2 * (m - k)) AS ipix1, n, total FROM held, top""")
def tree_leaves(spark, sf_dir):
    """Leaves with their samples, in both visiting orders."""
    depth = maps.leaves(points(spark, sf_dir), 1500)
    breadth = maps.leaves(points(spark, sf_dir), 1500, visit="breadthfirst").select("nside", "ipix", F.col("rank").alias("breadth"))
    total = F.aggregate("samples", F.lit(0).cast("long"), lambda a, x: a + x % 1000003)
    return depth.withColumn("total", total).withColumnRenamed("rank", "depth").drop("samples").join(breadth, ["nside", "ipix"])


@query(f"""WITH RECURSIVE {HISTOGRAM} SELECT 'all' AS key, 1::BIGINT << k AS nside, ipix, ipix << (2 * (29 - k)) AS ipix0, (ipix + 1) << (2 * (29 - k)) AS ipix1, n, coalesce(sum(p29 % 1000003), 0)::BIGINT AS total
    FROM leaf LEFT JOIN points ON (p29 >> (2 * (29 - k))) = ipix WHERE k > 0 OR n > 0 GROUP BY ALL""")
def tree_leaves_in_sql(spark, sf_dir):
    """The same from SQL, by the table function over partitioned input."""
    register.register(spark)
    points(spark, sf_dir).createOrReplaceTempView("tree_samples")
    rows = spark.sql("SELECT * FROM sky_tree_leaves(TABLE(SELECT 'all' AS map_id, p29 >> 58 AS base, p29 FROM tree_samples) PARTITION BY (map_id, base), 1500, 29)")
    return rows.select("key", "nside", "ipix", "ipix0", "ipix1", F.size("samples").cast("long").alias("n"), F.aggregate("samples", F.lit(0).cast("long"), lambda a, x: a + x % 1000003).alias("total"))


@query(f"""WITH RECURSIVE {HISTOGRAM}, top AS (SELECT max(k) AS m FROM leaf)
    SELECT ipix * pow(4, m - k)::BIGINT + c AS ipix, round(n / (pi() / 3 * pow(0.25, k)), 4) AS density FROM leaf, top, range(pow(4, 12)::BIGINT) r(c) WHERE c < pow(4, m - k)""")
def flat_bitmap(spark, sf_dir):
    h = maps.adaptive_histogram(points(spark, sf_dir), 1500)
    return maps.flat_bitmap(h, maps.highest_order(h)).select("ipix", F.round("density", 4).alias("density"))


# --- ordered prefix sums

GREEDY = f"""{SKY}, ranked AS (SELECT *, {AREA3} AS units, w * 4 / {AREA3} AS dens FROM sky), c AS (
    SELECT *, sum(w) OVER (PARTITION BY map_id ORDER BY dens DESC, uniq ROWS UNBOUNDED PRECEDING) AS cum_w,
           sum(units) OVER (PARTITION BY map_id ORDER BY dens DESC, uniq ROWS UNBOUNDED PRECEDING) AS cum_units,
           sum(w) OVER (PARTITION BY map_id) AS all_w FROM ranked)"""


def _ranked(spark, sf_dir):
    m = _units(sky_map(spark, sf_dir))
    return m.withColumn("dens", F.col("w") * 4 / F.col("units"))


@query(f"WITH {GREEDY} SELECT map_id, uniq, w, (cum_w / all_w)::DOUBLE AS cls FROM c")
def greedy_levels(spark, sf_dir):
    return credible.greedy_levels(_ranked(spark, sf_dir), "w", ["map_id"], F.col("dens")).select("map_id", "uniq", "w", "cls")


@query(f"WITH {GREEDY} SELECT map_id, uniq, w, (cum_w / all_w)::DOUBLE AS cls FROM c")
def greedy_levels_by_range(spark, sf_dir):
    return credible.greedy_levels(_ranked(spark, sf_dir), "w", ["map_id"], F.col("dens"), by_range=True).select("map_id", "uniq", "w", "cls")


@query(f"""WITH {GREEDY} SELECT map_id, l.level, round(min_by(pu + (l.level * all_w - pw) * (cum_units - pu) / (cum_w - pw), cum_w) * 41252.96124941928 / 768, 6) AS area
    FROM (SELECT *, cum_w - w AS pw, cum_units - units AS pu FROM c) c, (VALUES (0.5), (0.9)) l(level) WHERE cum_w >= l.level * all_w AND w > 0 GROUP BY 1, 2""")
def credible_area(spark, sf_dir):
    m = sky_map(spark, sf_dir)
    total = m.groupBy("map_id").agg(F.sum("w").alias("total"))
    m = m.join(total, "map_id").select("map_id", "uniq", (F.col("w") / F.col("total") / ix.uniq2pixarea("uniq")).alias("probdensity"))
    return credible.areas(m, [0.5, 0.9], ["map_id"]).select("map_id", F.col("level").cast("decimal(2,1)").alias("level"), F.round("area", 6).alias("area"))


@query(f"WITH {GREEDY} SELECT map_id, uniq FROM c WHERE (cum_w - w) / all_w < 0.5")
def credible_region(spark, sf_dir):
    return credible.region(_ranked(spark, sf_dir), "w", 0.5, ["map_id"], F.col("dens")).select("map_id", "uniq")


@query(f"""WITH {GREEDY} SELECT map_id, count(*) AS cells, max(cum_units) FILTER (cum_w * 2 <= all_w)::BIGINT AS half_units FROM c GROUP BY 1""")
def cumulative_area(spark, sf_dir):
    c = credible.curve(_ranked(spark, sf_dir), "w", F.col("dens"), F.col("units"), ["map_id"])
    total = c.groupBy("map_id").agg(F.sum("w").alias("all_w"))
    c = c.join(total, "map_id")
    return c.groupBy("map_id").agg(F.count(F.lit(1)).alias("cells"), F.max(F.when(F.col("cum_weight") * 2 <= F.col("all_w"), F.col("cum_area"))).alias("half_units"))


@query("""WITH e AS (SELECT event_type, value AS p, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) / count(*) OVER (PARTITION BY event_type) AS fraction FROM events)
    SELECT event_type, count(*) + 2 AS n, round(max(fraction), 9) AS top FROM e GROUP BY 1""")
def pp_series(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    s = stats.pp_series(e, "value", ["event_type"])
    return s.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("fraction"), 9).alias("top"))


# --- joins


@query(f"""WITH {SKY}, {POINTS} SELECT s.map_id, s.uniq, count(*) AS n, sum(s.w)::BIGINT AS w FROM points p JOIN sky s
    ON (p.p29 >> (2 * (29 - s.ord))) = s.ipix GROUP BY 1, 2""")
def locate_points(spark, sf_dir):
    hit = crossmatch.locate(points(spark, sf_dir), sky_map(spark, sf_dir))
    return hit.groupBy("map_id", "uniq").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"))


@query(f"""WITH {GREEDY}, {POINTS} SELECT c.map_id, count(*) AS n, sum(c.cum_units)::BIGINT AS units, sum(c.cum_w // 1000)::BIGINT AS w
    FROM points p JOIN c ON (p.p29 >> (2 * (29 - c.ord))) = c.ipix GROUP BY 1""")
def crossmatch_searched(spark, sf_dir):
    c = credible.curve(_ranked(spark, sf_dir), "w", F.col("dens"), F.col("units"), ["map_id"])
    hit = crossmatch.locate(points(spark, sf_dir), c.select("map_id", "uniq", "cum_weight", "cum_area"))
    return hit.groupBy("map_id").agg(F.count(F.lit(1)).alias("n"), F.sum("cum_area").alias("units"), F.sum(F.floor(F.col("cum_weight") / 1000)).alias("w"))


@query("""SELECT x, count(a.at) - 1 AS floor FROM (SELECT DISTINCT o_orderkey AS x FROM orders) o
    LEFT JOIN (SELECT DISTINCT s_suppkey * 97 + 50 AS at FROM supplier) a ON a.at <= x GROUP BY x""")
def find_floor(spark, sf_dir):
    ladder = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 97 + 50).alias("at")).distinct()
    keys = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("x")).distinct()
    return crossmatch.find_floor(keys, ladder)


@query("""SELECT e.user_id AS coinc_id, count(*) AS n, round(sqrt(sum(value * value)), 6) AS snr FROM events e WHERE value >= 20 GROUP BY 1
    HAVING count(*) >= 2 AND sqrt(sum(value * value)) >= 60""")
def detection_cuts(spark, sf_dir):
    kept = events.detection_cuts(triggers(spark, sf_dir), ["coinc_id"], 20.0, 60.0, 2)
    return kept.groupBy("coinc_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sqrt(F.sum(F.col("snr") * F.col("snr"))), 6).alias("snr"))


@query("SELECT user_id AS coinc_id, count(*) AS n, round(sqrt(sum(value * value)), 6) AS snr FROM events GROUP BY 1")
def coinc_summary(spark, sf_dir):
    s = events.coinc_summary(triggers(spark, sf_dir), ["coinc_id"], time="us")
    return s.select("coinc_id", "n", F.round("snr", 6).alias("snr"))


def _relational(spark, sf_dir):
    """Orders as coincidences, their lines as triggers and injections."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    sims = o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("coinc_event_id"), F.lit("sim_inspiral").alias("table_name"), F.col("o_custkey").alias("event_id"))
    coincs = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("coinc_event_id"), F.lit("coinc_event").alias("table_name"), (F.col("o_orderkey") + 1).alias("event_id"))
    sngl = li.select(F.col("l_orderkey").alias("coinc_event_id"), F.lit("sngl_inspiral").alias("table_name"), (F.col("l_orderkey") * 1000000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("event_id")).distinct()
    return sims.unionByName(coincs), sngl


@query("""SELECT DISTINCT a.o_orderkey + 1 AS coinc_event_id, a.o_custkey AS simulation_id, c.c_acctbal AS distance, b.o_totalprice AS snr
    FROM orders a JOIN customer c ON c.c_custkey = a.o_custkey JOIN orders b ON b.o_orderkey = a.o_orderkey + 1 WHERE a.o_orderkey % 6 = 0""")
def injection_lookup(spark, sf_dir):
    coinc_map, _ = _relational(spark, sf_dir)
    sim = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("simulation_id"), F.lit(0.0).alias("longitude"), F.lit(0.0).alias("latitude"), F.col("c_acctbal").alias("distance"))
    coinc = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("coinc_event_id"), F.lit(0.0).alias("combined_far"), F.col("o_totalprice").alias("snr"))
    return events.injection_for_coinc(coinc_map, sim, coinc).select("coinc_event_id", "simulation_id", "distance", "snr")


@query("""WITH s AS (SELECT DISTINCT l_orderkey, l_partkey, l_linenumber FROM lineitem), t AS (
    SELECT l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS event_id, min(l_returnflag) AS ifo, max(l_quantity) AS snr FROM lineitem GROUP BY 1)
    SELECT l_orderkey AS coinc_event_id, count(*) AS n, min(ifo) AS first_detector, sum(snr) AS snr FROM s JOIN t ON t.event_id = l_orderkey * 1000000 + l_partkey * 10 + l_linenumber
    JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""")
def event_assembly(spark, sf_dir):
    _, sngl_map = _relational(spark, sf_dir)
    li = table(spark, sf_dir, "lineitem").withColumn("event_id", F.col("l_orderkey") * 1000000 + F.col("l_partkey") * 10 + F.col("l_linenumber"))
    sngl = li.groupBy("event_id").agg(F.min("l_returnflag").alias("ifo"), F.max("l_quantity").alias("snr"))
    sngl = sngl.select("event_id", F.lit(0).alias("process_id"), "ifo", "snr", F.lit(0.5).alias("coa_phase"), F.lit(0.0).alias("end"))
    coinc = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("coinc_event_id"), F.lit(0).alias("process_id"), F.lit(0).alias("time_slide_id")).distinct()
    e = events.assemble(coinc, sngl_map, sngl)
    return e.select("coinc_event_id", F.size("singles").cast("long").alias("n"), F.element_at("singles", 1)["detector"].alias("first_detector"), F.aggregate("singles", F.lit(0.0), lambda a, s: a + s["snr"]).alias("snr"))


@query("""SELECT l_orderkey AS coinc_id, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_returnflag, l_quantity FROM lineitem WHERE l_returnflag <> 'R') GROUP BY 1""")
def exclude_detectors(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity").distinct()
    e = li.groupBy(F.col("l_orderkey").alias("coinc_id")).agg(F.collect_list(F.struct(F.col("l_returnflag").alias("detector"), F.col("l_quantity").alias("snr"))).alias("singles"))
    out = events.exclude_detectors(e, ["R"], raises=False).where(F.size("singles") > 0)
    return out.select("coinc_id", F.size("singles").cast("long").alias("n"))


@query("""SELECT o_orderkey, o_orderstatus FROM orders SEMI JOIN (SELECT DISTINCT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 7) c ON c.c_custkey = o_custkey""")
def definition_filter(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "coinc_def_id")
    d = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("coinc_def_id"), F.col("c_mktsegment").alias("search"), F.col("c_nationkey").alias("search_coinc_type"))
    return events.of_definition(o, d, "BUILDING", 7).select("o_orderkey", "o_orderstatus")


@query("""SELECT e.event_id, e.event_type AS ifo, (epoch_us(e.ts) // 1000000 // 7200) AS segment FROM events e""")
def psd_segments(spark, sf_dir):
    t = triggers(spark, sf_dir).withColumn("time", F.floor(F.col("us") / 1000000).cast("double"))
    low, high = t.agg(F.floor(F.min("time") / 7200), F.floor(F.max("time") / 7200)).first()
    seg = t.select("ifo").distinct().select("ifo", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("id")).select("ifo", (F.col("id") * 7200.0).alias("start"), ((F.col("id") + 1) * 7200.0).alias("end"), F.col("id").alias("segment"))
    return events.psd_segments(t, seg).select("event_id", "ifo", "segment")


@query("""WITH s AS (SELECT user_id, list_sort(list(value), 'DESC') AS v FROM events GROUP BY 1) SELECT user_id, v[2] AS snr FROM s""")
def decisive_snr(spark, sf_dir):
    return events.decisive_of(table(spark, sf_dir, "events").withColumnRenamed("value", "snr"), ["user_id"], 2)


# --- aggregates of maps


@query("""WITH d AS (SELECT c_custkey % 4 AS map_id, CAST(round(c_acctbal * 100) AS BIGINT) AS w, 100 + floor(abs(c_acctbal)) AS m FROM customer WHERE c_acctbal > 0)
    SELECT map_id, round(sum(w * m) / sum(w), 6) AS distmean, round(sqrt(sum(w * (m * m * 0.0625 + m * m)) / sum(w) - pow(sum(w * m) / sum(w), 2)), 4) AS diststd FROM d GROUP BY 1""")
def marginal_moments(spark, sf_dir):
    d = distances(spark, sf_dir).where("w > 0")
    total = d.groupBy("map_id").agg(F.sum("w").alias("total"))
    d = d.join(total, "map_id").withColumn("prob", F.col("w") / F.col("total"))
    out = moments.marginal_of_moments(d, ["map_id"])
    return out.select("map_id", F.round("distmean", 6).alias("distmean"), F.round("diststd", 4).alias("diststd"))


@query(f"WITH {FLAT} SELECT map_id, (min_by(ipix, (-w, ipix)) + 64)::BIGINT AS uniq FROM flat GROUP BY 1")
def posterior_max(spark, sf_dir):
    f = flat_map(spark, sf_dir).select("map_id", ix.nest2uniq(F.lit(2), F.col("ipix")).alias("uniq"), F.col("w").alias("prob"))
    return moments.posterior_max(f, ["map_id"]).select("map_id", "uniq")


@query(f"""WITH {FLAT}, c AS (SELECT p, z, sqrt(1 - z * z) * cos(phi) AS x, sqrt(1 - z * z) * sin(phi) AS y FROM {geo.cells('(SELECT 2 AS k, p FROM range(192) r(p))')}),
    s AS (SELECT map_id, sum(w * x) AS x, sum(w * y) AS y, sum(w * z) AS z FROM flat JOIN c ON c.p = flat.ipix GROUP BY 1)
    SELECT map_id, round(atan2(sqrt(x * x + y * y), z), 8) AS theta, round(atan2(y, x) + (atan2(y, x) < 0)::INT * 2 * pi(), 8) AS phi FROM s""")
def posterior_mean(spark, sf_dir):
    f = flat_map(spark, sf_dir).select("map_id", ix.nest2uniq(F.lit(2), F.col("ipix")).alias("uniq"), F.col("w").cast("double").alias("prob"))
    return moments.posterior_mean(f, ["map_id"]).select("map_id", F.round("theta", 8).alias("theta"), F.round("phi", 8).alias("phi"))


@query(f"WITH {SKY} SELECT map_id, CASE WHEN (CASE ord WHEN 2 THEN ipix ELSE ipix // 4 END) // 16 < 6 THEN 'north' ELSE 'south' END AS region, sum(w)::BIGINT AS prob FROM sky GROUP BY 1, 2")
def probability_by_region(spark, sf_dir):
    regions = spark.range(12).select((F.col("id") + 4).alias("uniq"), F.when(F.col("id") < 6, "north").otherwise("south").alias("region"))
    return moments.by_region(sky_map(spark, sf_dir).withColumnRenamed("w", "prob"), regions, ["map_id"])


@query("""SELECT event_type, round(log(sum(exp(CAST(value AS DOUBLE) / 100))) / log(2.718281828459045), 6) AS logsumexp FROM events GROUP BY 1""")
def log_sum_exp(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", (F.col("value") / 100).alias("x"))
    return moments.log_sum_exp(e, "x", ["event_type"]).select("event_type", F.round("logsumexp", 6).alias("logsumexp"))


@query("""WITH r AS (SELECT event_type, value AS v, user_id % 5 + 1 AS w FROM events WHERE value IS NOT NULL),
    t AS (SELECT event_type, v, before / max(before) OVER (PARTITION BY event_type)::DOUBLE AS pos FROM (SELECT event_type, v, sum(w) OVER (PARTITION BY event_type ORDER BY v, w ROWS UNBOUNDED PRECEDING) - w AS before FROM r)),
    e AS (SELECT event_type, q, max(v) FILTER (pos <= q) AS v0, max(pos) FILTER (pos <= q) AS a0, min(v) FILTER (pos > q) AS v1, min(pos) FILTER (pos > q) AS a1 FROM t, (SELECT unnest([0.25::DOUBLE, 0.5, 0.9]) AS q) GROUP BY 1, 2)
    SELECT event_type, q, round(v0 + (q - a0) / (a1 - a0) * (v1 - v0), 6) AS value FROM e""")
def weighted_quantile(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("w", F.col("user_id") % 5 + 1)
    return moments.weighted_quantile(e, "value", "w", [0.25, 0.5, 0.9], ["event_type"]).select("event_type", "q", F.round("value", 6).alias("value"))


@query("""SELECT event_type, least(floor(log10(value) / 2 * 10), 9)::INT AS bin, count(*)::DOUBLE AS n FROM events WHERE value BETWEEN 1 AND 100 GROUP BY 1, 2""")
def log_histogram(spark, sf_dir):
    return stats.histogram(table(spark, sf_dir, "events"), "value", 10, 1.0, 100.0, keys=["event_type"]).select("event_type", "bin", "n")


@query("""SELECT b.bound, count(*) AS n FROM events, (VALUES (1.0::DOUBLE), (10.0), (100.0)) b(bound) WHERE value >= b.bound GROUP BY 1""")
def threshold_groups(spark, sf_dir):
    t = stats.thresholds(table(spark, sf_dir, "events"), "value", [1.0, 10.0, 100.0])
    return t.groupBy("bound").agg(F.count(F.lit(1)).alias("n"))


# --- scalar functions


@query("""SELECT c_custkey, round(CASE WHEN abs(c_acctbal) > 0 THEN 1e-4 * abs(c_acctbal) * abs(c_acctbal) * exp(-0.5 * pow((abs(c_acctbal) - 5000) / 800, 2)) / (800 * sqrt(2 * pi())) ELSE 0 END, 9) AS pdf FROM customer""")
def conditional_pdf(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", F.round(distance.conditional_pdf(F.abs("c_acctbal"), F.lit(5000.0), F.lit(800.0), F.lit(1e-4)), 9).alias("pdf"))


@query("""SELECT c_custkey, round(acos(greatest(-1, least(1, sin(0.3) * sin(d) + cos(0.3) * cos(d) * cos(1.0 - r)))), 9) AS angle
    FROM (SELECT c_custkey, c_custkey % 628 / 100.0 AS r, (c_custkey % 313) / 100.0 - 1.56 AS d FROM customer)""")
def angle_distance(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 628 / 100.0).alias("r"), (F.col("c_custkey") % 313 / 100.0 - 1.56).alias("d"))
    return c.select("c_custkey", F.round(angles.angle_distance(F.lit(1.0), F.lit(0.3), "r", "d"), 9).alias("angle"))


@query("SELECT c_custkey, round(c_acctbal - 360 * floor((c_acctbal + 180) / 360), 6) AS reference, round(c_acctbal - 360 * floor(c_acctbal / 360), 6) AS wrapped FROM customer")
def wrapped_angles(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", F.round(angles.reference_angle_deg("c_acctbal"), 6).alias("reference"), F.round(angles.wrapped_angle_deg("c_acctbal"), 6).alias("wrapped"))


@query("""SELECT event_id, strftime(make_timestamp(t * 1000000 + 315964800000000 - n * 1000000), '%Y-%m-%dT%H:%M:%S.%f') AS utc FROM (
    SELECT event_id, t, (SELECT count(*) FROM (VALUES (46828800), (78364801), (109900802), (173059203), (252028804), (315187205), (346723206), (393984007), (425520008),
        (457056009), (504489610), (551750411), (599184012), (820108813), (914803214), (1025136015), (1119744016), (1167264017)) l(s) WHERE t >= s) AS n
    FROM (SELECT event_id, 40000000 + event_id * 97777 % 1300000000 AS t FROM events))""")
def gps_to_iso8601(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (40000000 + F.col("event_id") * 97777 % 1300000000).alias("t"))
    return e.select("event_id", gps.gps_to_iso8601("t").alias("utc"))


@query("SELECT event_id, (40000000 + event_id * 97777 % 1300000000)::DOUBLE AS gps FROM events")
def iso8601_to_gps(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", gps.gps_to_iso8601(40000000 + F.col("event_id") * 97777 % 1300000000).alias("utc"))
    return e.select("event_id", gps.iso8601_to_gps("utc").alias("gps"))


@query("SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS instruments FROM customer GROUP BY 1")
def instrument_union(spark, sf_dir):
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.collect_set("c_mktsegment").alias("v"))
    return c.select("c_nationkey", gps.instruments_to_text("v").alias("instruments"))




# --- maps with distance


def _distance_map(spark, sf_dir):
    """One map at order 1 with distance: cells weighed by customers."""
    c = table(spark, sf_dir, "customer").groupBy((F.col("c_custkey") % 48).alias("ipix")).agg(F.sum(F.abs("c_acctbal")).alias("w"), (F.floor(F.sum(F.round(F.abs("c_acctbal") * 100).cast("long")) / F.count(F.lit(1)) / 100) + 0.25).alias("m"))
    total = c.agg(F.sum("w")).first()[0]
    m = c.select((F.col("ipix") + 16).alias("uniq"), (F.col("w") / F.lit(total)).alias("prob"), distance.to_parameters(F.col("m"), F.col("m") * 0.25).alias("q"))
    return m.select("uniq", "prob", (F.col("prob") / ix.uniq2pixarea("uniq")).alias("probdensity"), "q.distmu", "q.distsigma", "q.distnorm")


@query("""SELECT c_custkey % 48 + 16 AS uniq, round(floor(sum(CAST(round(abs(c_acctbal) * 100) AS BIGINT)) / count(*) / 100) + 0.25, 2) AS distmean, round((floor(sum(CAST(round(abs(c_acctbal) * 100) AS BIGINT)) / count(*) / 100) + 0.25) * 0.25, 2) AS diststd FROM customer GROUP BY 1""")
def moments_roundtrip(spark, sf_dir):
    m = _distance_map(spark, sf_dir).withColumn("m", distance.to_moments("distmu", "distsigma"))
    return m.select("uniq", F.round("m.distmean", 2).alias("distmean"), F.round("m.diststd", 2).alias("diststd"))


@query(f"""WITH RECURSIVE {geo.DMAP}, b AS (
        SELECT 0 AS step, ipix, mu, sigma, norm, 0::DOUBLE AS low, 20000::DOUBLE AS high FROM dmap
        UNION ALL SELECT step + 1, ipix, mu, sigma, norm, CASE WHEN less THEN (low + high) / 2 ELSE low END, CASE WHEN less THEN high ELSE (low + high) / 2 END
        FROM (SELECT *, {geo.ansatz_cdf('((low + high) / 2)')} < 0.5 AS less FROM b WHERE step < 45))
    SELECT ipix + 16 AS uniq, round({geo.ansatz_cdf('5000.0')}, 7) AS cdf, round((low + high) / 2, 4) AS median FROM b WHERE step = 45""")
def distance_cdf(spark, sf_dir):
    d = _distance_map(spark, sf_dir).select("uniq", distance.conditional_cdf(F.lit(5000.0), "distmu", "distsigma", "distnorm").alias("cdf"), distance.conditional_ppf(F.lit(0.5), "distmu", "distsigma", "distnorm").alias("median"))
    return d.select("uniq", F.round("cdf", 7).alias("cdf"), F.round("median", 4).alias("median"))


@query(f"""WITH RECURSIVE {geo.DMAP} SELECT r, round(sum(prob * {geo.ansatz_pdf('r')}), 10) AS pdf, round(sum(prob * {geo.ansatz_cdf('r')}), 7) AS cdf
    FROM dmap, (SELECT (1000 * i)::DOUBLE AS r FROM range(1, 12) t(i)) GROUP BY r""")
def marginal_distance(spark, sf_dir):
    m = _distance_map(spark, sf_dir)
    radii = [1000.0 * k for k in range(1, 12)]
    both = moments.marginal_pdf(m, radii).join(moments.marginal_cdf(m, radii), "r")
    return both.select("r", F.round("pdf", 10).alias("pdf"), F.round("cdf", 7).alias("cdf"))


@query(f"""WITH RECURSIVE {geo.DMAP}, asked AS (SELECT * FROM (VALUES (0.5, 0.25, 0.75), (0.9, 0.05, 0.95)) v(level, a, b)),
    b AS (SELECT 0 AS step, s::DOUBLE AS s, 0::DOUBLE AS low, 30000::DOUBLE AS high FROM (SELECT a AS s FROM asked UNION ALL SELECT b FROM asked)
        UNION ALL SELECT step + 1, s, CASE WHEN less THEN (low + high) / 2 ELSE low END, CASE WHEN less THEN high ELSE (low + high) / 2 END
        FROM (SELECT *, (SELECT sum(prob * {geo.ansatz_cdf('((low + high) / 2)')}) FROM dmap) < s AS less FROM b WHERE step < 45)),
    q AS (SELECT s, round((low + high) / 2, 2) AS d FROM b WHERE step = 45)
    SELECT level::DOUBLE AS level, x.d AS low, y.d AS high FROM asked JOIN q x ON x.s = a JOIN q y ON y.s = b""")
def distance_intervals(spark, sf_dir):
    d = crossmatch.distance_intervals(_distance_map(spark, sf_dir), [0.5, 0.9])
    return d.select("level", F.round("low", 2).alias("low"), F.round("high", 2).alias("high"))


@query()
def principal_axes(spark, sf_dir):
    return moments.principal_axes(_distance_map(spark, sf_dir))


COARSE = f"""{geo.DMOM}, coarse AS (SELECT ipix, prob, mean, sqrt(q - mean * mean) AS std FROM (
    SELECT ipix // 4 AS ipix, sum(prob) AS prob, sum(prob * mean) / sum(prob) AS mean, sum(prob * (std * std + mean * mean)) / sum(prob) AS q FROM dmom GROUP BY 1)),
    {geo.parameters('coarse_map', 'coarse', 'ipix, prob')}
    SELECT ipix, round(prob, 10) AS prob, round(mu, 4) AS distmu, round(sigma, 4) AS distsigma, round(norm * 1e8, 6) AS distnorm FROM coarse_map"""


def _rounded_layers(df):
    return df.select("ipix", F.round("prob", 10).alias("prob"), F.round("distmu", 4).alias("distmu"), F.round("distsigma", 4).alias("distsigma"), F.round(F.col("distnorm") * 1e8, 6).alias("distnorm"))


@query(f"WITH RECURSIVE {COARSE}")
def rasterize_distance(spark, sf_dir):
    return _rounded_layers(maps.rasterize_distance(_distance_map(spark, sf_dir), 0))


@query(f"WITH RECURSIVE {COARSE}")
def ud_grade_distance(spark, sf_dir):
    m = _distance_map(spark, sf_dir).select((F.col("uniq") - 16).alias("ipix"), "prob", "distmu", "distsigma", "distnorm")
    return _rounded_layers(maps.ud_grade_distance(m, 1, 0))


VOXELS = f"""{geo.DMAP}, reach AS (SELECT greatest(6 * (SELECT sum(prob * mean) FROM dmom), {{far}}) / 1000 AS d),
    vox AS (SELECT ipix, i AS shell, prob / (pi() / 12) * norm * exp(-0.5 * pow((i * d - mu) / sigma, 2)) / (sigma * sqrt(2 * pi())) AS rate,
        (i * d * i * d + d * d / 12) * d * (pi() / 12) AS dv FROM dmap, reach, range(1, 1000) t(i)),
    run AS (SELECT *, sum(rate * dv) OVER w AS cum_p, sum(dv) OVER w AS cum_v, rate * dv AS dp FROM vox WINDOW w AS (ORDER BY rate DESC, ipix, shell ROWS UNBOUNDED PRECEDING))"""
#: The marginal distribution at every shell, from (0, 0).
DISTANCES = f"grid AS (SELECT h AS i, h * d AS r, CASE h WHEN 0 THEN 0 ELSE sum(prob * {geo.ansatz_cdf('(h * d)')}) END AS p FROM dmap, reach, range(1000) t(h) GROUP BY h, d)"
SUPPLIERS = "SELECT s_suppkey AS id, (s_suppkey % 628 / 100.0)::DOUBLE AS phi, sin((s_suppkey % 300 / 100.0 - 1.5)::DOUBLE) AS z, (2000 + abs(s_acctbal) / 2)::DOUBLE AS dist FROM supplier"
_FAR = "(SELECT max(2000 + abs(s_acctbal) / 2) FROM supplier)"
#: The voxel of every target: its cell in the shell at or below its distance, the first and last shells beyond.
FOUND = f"""hit AS (SELECT * FROM {geo.lookup(f"({SUPPLIERS})", 1)}), found AS (SELECT h.*, p AS ipix, greatest(1, least(999, floor(dist / d)))::INT AS shell, floor(dist / d)::INT AS below, dist / d AS steps FROM hit h, reach),
    space AS (SELECT f.id, cum_v, cum_p, rate, CASE WHEN dist > d * 999 THEN 1 ELSE a.p + (steps - below) * (b.p - a.p) END AS along
        FROM found f JOIN run r ON r.ipix = f.ipix AND r.shell = f.shell, reach, grid a, grid b WHERE a.i = least(below, 998) AND b.i = a.i + 1)"""


def _suppliers(spark, sf_dir):
    c = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 628 / 100.0).alias("ra"), (F.col("s_suppkey") % 300 / 100.0 - 1.5).alias("dec"), (2000 + F.abs("s_acctbal") / 2).alias("distance"))
    return crossmatch.catalog_points(c)


@query(f"""WITH RECURSIVE {VOXELS.replace("{far}", _FAR)}, {DISTANCES}, {FOUND}
    SELECT id, round(cum_v / 1e9, 3) AS searched_vol, round(cum_p, 7) AS searched_prob_vol, round(rate * 1e12, 5) AS probdensity_vol, round(along, 7) AS searched_prob_dist FROM space""")
def crossmatch_3d(spark, sf_dir):
    objects, _ = crossmatch.searched_volume(_distance_map(spark, sf_dir).drop("prob"), _suppliers(spark, sf_dir))
    return objects.select("id", F.round(F.col("searched_vol") / 1e9, 3).alias("searched_vol"), F.round("searched_prob_vol", 7).alias("searched_prob_vol"), F.round(F.col("probdensity_vol") * 1e12, 5).alias("probdensity_vol"), F.round("searched_prob_dist", 7).alias("searched_prob_dist"))


@query(f"""WITH RECURSIVE {VOXELS.replace("{far}", "0")}, l AS (SELECT unnest([0.5::DOUBLE, 0.9::DOUBLE]) AS level)
    SELECT level, round(min_by(cum_v - dv + (level - cum_p + dp) * dv / dp, cum_p) / 1e9, 3) AS volume FROM run, l WHERE cum_p >= level AND dp > 0 GROUP BY level""")
def contour_volumes(spark, sf_dir):
    volumes = crossmatch.contour_volumes(_distance_map(spark, sf_dir).drop("prob"), [0.5, 0.9])
    return volumes.select("level", F.round(F.col("volume") / 1e9, 3).alias("volume"))


RAYS = """far AS (SELECT greatest(18000, max(greatest(mu, 0) + 6 * sigma)) AS reach FROM dmap), n AS (SELECT reach, greatest(200, floor(200 * reach / 18000))::BIGINT AS steps FROM far),
    ray AS (SELECT i, j, (i + 0.5::DOUBLE) * 1500 - 12000 AS x, (j + 0.5::DOUBLE) * 1500 - 12000 AS y, s * abs(s) * reach AS zz, 2 * abs(s) * reach * 2 / (steps - 1) AS width
        FROM (SELECT i, j, reach, steps, -1 + 2 * k / (steps - 1)::DOUBLE AS s FROM n, range(16) a(i), range(16) b(j), range(2000) c(k) WHERE k < steps)),
    dir AS (SELECT i, j, width, r, zz / r AS z, atan2(y, x) + (atan2(y, x) < 0)::INT * 2 * pi() AS phi FROM (SELECT *, sqrt(x * x + y * y + zz * zz) AS r FROM ray))"""


@query(f"""WITH RECURSIVE {geo.DMAP}, {RAYS}, hit AS (SELECT * FROM {geo.lookup('dir', 1)})
    SELECT i::INT AS i, j::INT AS j, round(sum(prob / (pi() / 12) * {geo.ansatz_pdf('r')} / (r * r) * width) * 1e10, 4) AS density FROM hit JOIN dmap ON ipix = p GROUP BY i, j""")
def volume_render(spark, sf_dir):
    v = image.volume_render(_distance_map(spark, sf_dir), 16, 12000.0)
    return v.select("i", "j", F.round(F.col("density") * 1e10, 4).alias("density"))


# --- direction


def _catalog(spark, sf_dir):
    """Customers as directions; ``sine`` is that of dec."""
    c, z = table(spark, sf_dir, "customer"), (F.col("c_custkey") * 17 % 1999 - 999) / 1000.0
    return c.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 37 % 628 / 100.0).alias("ra"), F.asin(z).alias("dec"), z.alias("sine"))


def _density_map(spark, sf_dir):
    m = sky_map(spark, sf_dir)
    total = m.groupBy("map_id").agg(F.sum("w").alias("total"))
    return m.join(total, "map_id").select("map_id", "uniq", (F.col("w") / F.col("total") / ix.uniq2pixarea("uniq")).alias("probdensity"))


CUSTOMERS = "SELECT c_custkey AS id, (c_custkey * 37 % 628 / 100.0)::DOUBLE AS phi, ((c_custkey * 17 % 1999 - 999) / 1000.0)::DOUBLE AS z FROM customer"


@query(f"""WITH {GREEDY}, hit AS (SELECT * FROM {geo.lookup(f"({CUSTOMERS})", 3)}),
    best AS (SELECT map_id, z AS bz, phi AS bphi FROM {geo.cells("(SELECT map_id, min_by(ord, (-dens, uniq)) AS k, min_by(ipix, (-dens, uniq)) AS p FROM c GROUP BY 1)")})
    SELECT map_id, count(*) AS n, round(avg(degrees(acos(greatest(-1, least(1, z * bz + sqrt(1 - z * z) * sqrt(1 - bz * bz) * cos(phi - bphi)))))), 6) AS "offset",
        round(avg(cum_units * 41252.96124941928 / 768), 6) AS searched_area, round(avg(cum_w / all_w), 9) AS searched_prob
    FROM hit JOIN c ON c.ipix = hit.p // (CASE ord WHEN 2 THEN 4 ELSE 1 END) JOIN best USING (map_id) GROUP BY 1""")
def searched_offset(spark, sf_dir):
    hit = crossmatch.searched(_density_map(spark, sf_dir), crossmatch.catalog_points(_catalog(spark, sf_dir), z="sine"), ["map_id"])
    return hit.groupBy("map_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("offset"), 6).alias("offset"), F.round(F.avg("searched_area"), 6).alias("searched_area"), F.round(F.avg("searched_prob"), 9).alias("searched_prob"))


@query(f"""WITH {GREEDY} SELECT map_id, round(max_by(pw + (100.0 * 768 / 41252.96124941928 - pu) * (cum_w - pw) / (cum_units - pu), -cum_units) / max(all_w), 9) AS prob
    FROM (SELECT *, cum_w - w AS pw, cum_units - units AS pu FROM c) c WHERE cum_units >= 100.0 * 768 / 41252.96124941928 GROUP BY 1""")
def area_probability(spark, sf_dir):
    p = crossmatch.area_probs(_density_map(spark, sf_dir), [100.0], ["map_id"])
    return p.select("map_id", F.round("prob", 9).alias("prob"))


def _modes_sql(mask: str, order: int, tag: str = "") -> str:
    """Connected components of ``mask`` (map_id, ipix), by the smallest pixel that each one reaches; ``tag`` ends the names."""
    return f"""corner{tag} AS {geo.corners(order)}, near{tag} AS (SELECT DISTINCT a.p AS a, b.p AS b FROM corner{tag} a JOIN corner{tag} b ON a.key = b.key AND a.p <> b.p),
    mask{tag} AS ({mask}), edge{tag} AS (SELECT m.map_id, e.a, e.b FROM near{tag} e JOIN mask{tag} m ON m.ipix = e.a JOIN mask{tag} n ON n.ipix = e.b AND n.map_id = m.map_id),
    reach{tag} AS (SELECT map_id, ipix, ipix AS seen FROM mask{tag} UNION SELECT r.map_id, r.ipix, e.b FROM reach{tag} r JOIN edge{tag} e ON e.map_id = r.map_id AND e.a = r.seen),
    modes{tag} AS (SELECT map_id, count(DISTINCT least) AS modes FROM (SELECT map_id, ipix, min(seen) AS least FROM reach{tag} GROUP BY 1, 2) GROUP BY 1)"""


def _map_stats_sql() -> str:
    region = lambda level: f"SELECT map_id, CASE ord WHEN 2 THEN 4 * ipix + j ELSE ipix END AS ipix FROM c, range(4) r(j) WHERE cum_w / all_w <= {level} AND (ord = 2 OR j = 0)"
    modes = [_modes_sql(region(x), 3, tag) for x, tag in ((0.5, "_a"), (0.9, "_b"))]
    area = lambda level: f"round(min_by(pu + ({level} * all_w - pw) * (cum_units - pu) / (cum_w - pw), cum_w) FILTER (cum_w >= {level} * all_w AND w > 0) * 41252.96124941928 / 768, 6)"
    prob = "round(max_by(pw + (100.0 * 768 / 41252.96124941928 - pu) * (cum_w - pw) / (cum_units - pu), -cum_units) FILTER (cum_units >= 100.0 * 768 / 41252.96124941928) / max(all_w), 9)"
    return f"""WITH RECURSIVE {GREEDY}, {modes[0]}, {modes[1]}, d AS (SELECT *, cum_w - w AS pw, cum_units - units AS pu FROM c)
        SELECT map_id, {area(0.5)} AS "area(50)", {area(0.9)} AS "area(90)", {prob} AS "prob(100)", max(m.modes) AS "modes(50)", max(n.modes) AS "modes(90)"
        FROM d JOIN modes_a m USING (map_id) JOIN modes_b n USING (map_id) GROUP BY map_id"""


@query(_map_stats_sql())
def map_stats(spark, sf_dir):
    out = crossmatch.stats(_density_map(spark, sf_dir), None, [0.5, 0.9], [100.0], True)
    digits = {"area(50)": 6, "area(90)": 6, "prob(100)": 9}
    return out.select("map_id", *[F.round(f"`{c}`", k).alias(c) for c, k in digits.items()], "`modes(50)`", "`modes(90)`")


@query(f"WITH RECURSIVE {FLAT}, {_modes_sql('SELECT map_id, ipix FROM flat WHERE w > 400000000', 2)} SELECT map_id, modes FROM modes")
def count_modes(spark, sf_dir):
    f = flat_map(spark, sf_dir).where("w > 400000000")
    return crossmatch.count_modes(f, 2, ["map_id"])


@query(f"""WITH RECURSIVE {FLAT}, seeds AS (SELECT map_id, min(ipix) AS seed FROM flat WHERE w > 300000000 GROUP BY 1), {_modes_sql('SELECT map_id, ipix FROM flat WHERE w > 300000000', 2)}
    SELECT r.map_id, r.seen AS ipix FROM reach r JOIN seeds s ON s.map_id = r.map_id AND s.seed = r.ipix""")
def flood_fill(spark, sf_dir):
    mask = flat_map(spark, sf_dir).where("w > 300000000")
    seeds = mask.groupBy("map_id").agg(F.min("ipix").alias("ipix"))
    return crossmatch.flood_fill(mask, 2, seeds, ["map_id"])


@query(f"WITH {FLAT} SELECT map_id, o AS ipix, round(sum(x.w * flat.w) / (4 * pi()), 1) AS prob FROM {geo.weights(2, 3)} x JOIN flat ON flat.ipix = x.p GROUP BY 1, 2")
def smooth_ud_grade(spark, sf_dir):
    f = flat_map(spark, sf_dir).select("map_id", "ipix", F.col("w").cast("double").alias("prob"))
    return maps.smooth_ud_grade(f, 2, 3, ["map_id"]).select("map_id", "ipix", F.round(F.col("prob") / F.lit(np.pi), 1).alias("prob"))


@query(f"""WITH {FLAT}, e2 AS (SELECT map_id, ipix, floor(w / 200000000)::DOUBLE AS v FROM flat),
    e1 AS (SELECT map_id, ipix // 4 AS ipix, avg(v) AS v FROM e2 GROUP BY 1, 2), c0 AS (SELECT map_id, ipix // 4 AS ipix, avg(v) AS v FROM e1 GROUP BY 1, 2),
    t1 AS (SELECT map_id, ipix // 4 AS up FROM e1 GROUP BY 1, 2 HAVING min(v) = max(v)), s1 AS (SELECT map_id, o, sum(x.w * v) AS s FROM {geo.weights(0, 1)} x JOIN c0 ON c0.ipix = x.p GROUP BY 1, 2),
    c1 AS (SELECT e1.map_id, e1.ipix, CASE WHEN t1.up IS NULL THEN v ELSE s END AS v FROM e1 LEFT JOIN t1 ON t1.map_id = e1.map_id AND t1.up = e1.ipix // 4 JOIN s1 ON s1.map_id = e1.map_id AND s1.o = e1.ipix),
    t2 AS (SELECT map_id, ipix // 4 AS up FROM e2 GROUP BY 1, 2 HAVING min(v) = max(v)), s2 AS (SELECT map_id, o, sum(x.w * v) AS s FROM {geo.weights(1, 2)} x JOIN c1 ON c1.ipix = x.p GROUP BY 1, 2)
    SELECT e2.map_id, e2.ipix, round(CASE WHEN t2.up IS NULL THEN v ELSE s END, 8) AS value FROM e2 LEFT JOIN t2 ON t2.map_id = e2.map_id AND t2.up = e2.ipix // 4 JOIN s2 ON s2.map_id = e2.map_id AND s2.o = e2.ipix""")
def interpolate_nested(spark, sf_dir):
    f = flat_map(spark, sf_dir).select("map_id", "ipix", F.floor(F.col("w") / 200000000).cast("double").alias("value"))
    return maps.interpolate_nested(f, 2, ["map_id"]).select("map_id", "ipix", F.round("value", 8).alias("value"))


def _grid_sql(rounds: int) -> str:
    value = lambda source: f"SELECT k, p, sum(nw * exp(8 * (z * nz + sqrt(1 - z * z) * sqrt(1 - nz * nz) * cos(phi - nphi) - 1))) AS d FROM {geo.cells(source)}, nations GROUP BY k, p"
    parts = ["nations AS (SELECT c_nationkey, (2 * c_nationkey - 24) / 26.0::DOUBLE AS nz, (c_nationkey * 2.4)::DOUBLE AS nphi, sum(abs(round(c_acctbal * 100)))::DOUBLE / 1e6 AS nw FROM customer GROUP BY 1)"]
    parts += [f"g0 AS ({value('(SELECT 2 AS k, p FROM range(192) r(p))')})"]
    for i in range(rounds):
        parts.append(f"c{i} AS (SELECT k, p FROM g{i} ORDER BY d * pow(0.25, k) DESC, p + pow(4, k + 1) LIMIT 48)")
        parts.append(f"g{i + 1} AS (SELECT * FROM g{i} ANTI JOIN c{i} USING (k, p) UNION ALL {value(f'(SELECT k + 1 AS k, 4 * p + j AS p FROM c{i}, range(4) r(j))')})")
    return ", ".join(parts)


@query(f"WITH {_grid_sql(3)} SELECT p + pow(4, k + 1)::BIGINT AS uniq, round(d / sum(d * pi() / 3 * pow(0.25, k)) OVER (), 8) AS probdensity FROM g3")
def adaptive_grid(spark, sf_dir):
    """Refined where the density is: a bell about a place of each nation, weighed by its customers (25 rows at most)."""
    own = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg((F.sum(F.abs(F.round(F.col("c_acctbal") * 100))) / 1e6).alias("w")).orderBy("c_nationkey").collect()

    def density(theta, phi):
        total = F.lit(0.0)
        for r in own:
            z, turn = (2 * r.c_nationkey - 24) / 26.0, r.c_nationkey * 2.4
            total = total + r.w * F.exp(8 * (F.cos(theta) * z + F.sin(theta) * float(np.sqrt(1 - z * z)) * F.cos(phi - turn) - 1))
        return total

    g = maps.adaptive_grid(spark, density, 2, 3)
    return g.select("uniq", F.round("probdensity", 8).alias("probdensity"))


@query()
def contour_polygons(spark, sf_dir):
    f = flat_map(spark, sf_dir).withColumn("uniq", F.col("ipix"))
    return contours.polygons(credible.greedy_levels(f, "w", ["map_id"]).select("map_id", "ipix", "cls"), 2, [0.5, 0.9], ["map_id"])


@query()
def contour_geojson(spark, sf_dir):
    return contours.geojson(contour_polygons(spark, sf_dir), ["map_id"])


def _rings_sql(region: str, corners: str, level: str = "level") -> str:
    """Rings of the boundary of ``region`` (map_id, level, p) by the corners of its pixels: sides that no two pixels share, joined where they meet; of four at a corner those of the same pixel."""
    return f"""region AS ({region}), corner AS (SELECT DISTINCT p, d, key FROM {corners}),
    side AS (SELECT r.map_id, r.level, r.p, a.d, least(a.key, b.key) AS k1, greatest(a.key, b.key) AS k2 FROM region r JOIN corner a ON a.p = r.p JOIN corner b ON b.p = r.p AND b.d = (a.d + 1) % 4),
    edge AS (SELECT map_id, level, min(4 * p + d) AS id, min(p) AS p, k1, k2 FROM side GROUP BY map_id, level, k1, k2 HAVING count(*) = 1),
    ends AS (SELECT map_id, level, id, p, k1 AS key FROM edge UNION ALL SELECT map_id, level, id, p, k2 FROM edge), busy AS (SELECT map_id, level, key, count(*) AS n FROM ends GROUP BY ALL),
    link AS (SELECT a.map_id, a.level, a.id AS a, b.id AS b FROM ends a JOIN ends b ON b.map_id = a.map_id AND b.level = a.level AND b.key = a.key AND b.id <> a.id JOIN busy n ON n.map_id = a.map_id AND n.level = a.level AND n.key = a.key WHERE n.n = 2 OR a.p = b.p),
    label(map_id, level, id, root) USING KEY (map_id, level, id) AS (SELECT map_id, level, id, id FROM edge
        UNION SELECT l.map_id, l.level, k.b, min(l.root) FROM label l JOIN link k ON k.map_id = l.map_id AND k.level = l.level AND k.a = l.id JOIN recurring.label r ON r.map_id = l.map_id AND r.level = l.level AND r.id = k.b WHERE l.root < r.root GROUP BY ALL),
    ring AS (SELECT l.map_id, l.level, l.root, count(*) AS length, min(e.p) AS first, sum(e.p)::BIGINT AS pixels FROM label l JOIN edge e USING (map_id, level, id) GROUP BY ALL)"""


def _named_corners(source: str, digits: int = 9) -> str:
    """(p, d, key) of the corners of the pixels of ``source`` (k, p), named by their place; d goes round."""
    own = f"(SELECT k, p, d FROM {source}, range(4) s(d))"
    return f"(SELECT p, d, (round(z, {digits}) + 0.0)::VARCHAR || ':' || (round(round(phi / (pi() / 2), {digits}) % 4 * (abs(z) < 0.9999999999)::INT, {digits}) + 0.0)::VARCHAR AS key FROM {geo.cells(own, '(d // 2)', '((d + 1) // 2 % 2)')})"


_LEVELS = "(SELECT unnest([0.5::DOUBLE, 0.9::DOUBLE]) AS level)"


@query(f"""WITH RECURSIVE {FLAT}, cls AS (SELECT map_id, ipix, sum(w) OVER (PARTITION BY map_id ORDER BY w DESC, ipix ROWS UNBOUNDED PRECEDING) / sum(w) OVER (PARTITION BY map_id) AS c FROM flat),
    {_rings_sql(f"SELECT map_id, level, ipix AS p FROM cls, {_LEVELS} WHERE c <= level", _named_corners('(SELECT 2 AS k, p FROM range(192) r(p))'))} SELECT map_id, level, length, first, pixels FROM ring""")
def contour_rings(spark, sf_dir):
    """The rings of four maps: length, smallest pixel, and the sum of the pixels along it."""
    f = credible.greedy_levels(flat_map(spark, sf_dir), "w", ["map_id"], tie="ipix")
    r = contours.rings(contours.boundary_edges(f.select("map_id", "ipix", "cls"), 2, [0.5, 0.9], ["map_id"]), 2, ["map_id"])
    return r.groupBy("map_id", "level", "ring").agg(F.count(F.lit(1)).alias("length"), F.min("ipix").alias("first"), F.sum("ipix").alias("pixels")).drop("ring")


@query(f"""WITH RECURSIVE large AS (SELECT ((l_orderkey * 1000003 + l_partkey * 10007) * 1299709) % 3458764513820540928 >> 42 AS p, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS w FROM lineitem GROUP BY 1),
    cls AS (SELECT p, sum(w) OVER (ORDER BY w DESC, p ROWS UNBOUNDED PRECEDING) / sum(w) OVER () AS c FROM large), held AS (SELECT 0 AS map_id, level, p FROM cls, {_LEVELS} WHERE c <= level),
    {_rings_sql('SELECT * FROM held', _named_corners('(SELECT DISTINCT 8 AS k, p FROM held)', 10))} SELECT level, length, count(*) AS rings, sum(pixels)::BIGINT AS pixels FROM ring GROUP BY ALL""")
def large_map_contours(spark, sf_dir):
    """Contours of one map at order 8, whose cells grow with the data: rings by their length."""
    li = table(spark, sf_dir, "lineitem")
    m = li.groupBy(F.shiftright(line_pixels(), 42).alias("ipix")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("w"))
    levels = credible.greedy_levels(m, "w", tie="ipix").select("ipix", "cls")
    r = contours.rings(contours.boundary_edges(levels, 8, [0.5, 0.9]), 8)
    r = r.groupBy("level", "ring").agg(F.count(F.lit(1)).alias("length"), F.sum("ipix").alias("pixels"))
    return r.groupBy("level", "length").agg(F.count(F.lit(1)).alias("rings"), F.sum("pixels").alias("pixels"))


def _median_sql(c: str) -> str:
    """Weighted median of a coordinate: linear between rows that stand at (weight before) / (total less the last weight)."""
    return f"""m{c} AS (SELECT map_id, max(v) FILTER (pos <= 0.5) AS v0, max(pos) FILTER (pos <= 0.5) AS a0, min(v) FILTER (pos > 0.5) AS v1, min(pos) FILTER (pos > 0.5) AS a1 FROM (
        SELECT map_id, v, before / max(before) OVER (PARTITION BY map_id) AS pos FROM (SELECT map_id, {c} AS v, sum(w) OVER (PARTITION BY map_id ORDER BY {c}, w ROWS UNBOUNDED PRECEDING) - w AS before FROM sky)) GROUP BY 1)"""


def _ellipse_sql() -> str:
    part = lambda ab, a, b: f"((sum({ab}) - sum({a}) * sum({b}) / sum(w)) / (sum(w) - sum(w * w) / sum(w)))"
    rounds = []
    for k in range(3):
        rounds.append(f"k{k} AS (SELECT map_id, {part('w * px * px', 'w * px', 'w * px')} AS cxx, {part('w * px * py', 'w * px', 'w * py')} AS cxy, {part('w * py * py', 'w * py', 'w * py')} AS cyy FROM p{k} WHERE keep GROUP BY 1)")
        rounds.append(f"p{k + 1} AS (SELECT map_id, ipix, w, px, py, s, keep AND s < 3 AS keep FROM (SELECT p.*, sqrt((cyy * px * px - 2 * cxy * px * py + cxx * py * py) / (cxx * cyy - cxy * cxy)) AS s FROM (SELECT map_id, ipix, w, px, py, keep FROM p{k}) p JOIN k{k} USING (map_id)))")
    return f"""WITH RECURSIVE {FLAT}, sky AS (SELECT map_id, ipix, f.w * exp(4 * (c.z * cos(1) + sqrt(1 - c.z * c.z) * sin(1) * cos(phi - 2))) / sum(f.w * exp(4 * (c.z * cos(1) + sqrt(1 - c.z * c.z) * sin(1) * cos(phi - 2)))) OVER (PARTITION BY map_id) AS w, round(sqrt(1 - c.z * c.z) * cos(phi), 13) + 0.0 AS x, round(sqrt(1 - c.z * c.z) * sin(phi), 13) + 0.0 AS y, round(c.z, 13) + 0.0 AS z FROM flat f JOIN {geo.cells('(SELECT 2 AS k, p FROM range(192) r(p))')} c ON c.p = f.ipix),
        {_median_sql('x')}, {_median_sql('y')}, {_median_sql('z')}, centre AS (SELECT map_id, atan2(cy, cx) AS ra, asin(cz / sqrt(cx * cx + cy * cy + cz * cz)) AS dec FROM (SELECT map_id, {', '.join(f'm{c}.v0 + (0.5 - m{c}.a0) / (m{c}.a1 - m{c}.a0) * (m{c}.v1 - m{c}.v0) AS c{c}' for c in 'xyz')} FROM mx JOIN my USING (map_id) JOIN mz USING (map_id))),
        flatter AS (SELECT map_id, ipix, w, x * cos(dec) * cos(ra) + y * cos(dec) * sin(ra) + z * sin(dec) AS d, y * cos(ra) - x * sin(ra) AS e, z * cos(dec) - x * sin(dec) * cos(ra) - y * sin(dec) * sin(ra) AS n FROM sky JOIN centre USING (map_id)),
        p0 AS (SELECT map_id, ipix, w, e * t AS px, n * t AS py, true AS keep FROM (SELECT *, degrees(atan2(sqrt(e * e + n * n), d)) / sqrt(e * e + n * n) AS t FROM flatter)), {', '.join(rounds)},
        run AS (SELECT map_id, s, sum(w) OVER o AS c, count(*) OVER o * degrees(degrees(pi() / 3 / 16)) AS a FROM p3 WINDOW o AS (PARTITION BY map_id ORDER BY s, ipix ROWS UNBOUNDED PRECEDING)),
        low AS (SELECT map_id, level, max(c) AS c, max(s) AS s, max(a) AS a FROM run, {_LEVELS} WHERE c <= level GROUP BY 1, 2), high AS (SELECT map_id, level, min(c) AS c, min(s) AS s, min(a) AS a FROM run, {_LEVELS} WHERE c > level GROUP BY 1, 2),
        hit AS (SELECT map_id, level, l.s + (level - l.c) / (h.c - l.c) * (h.s - l.s) AS n, l.a + (level - l.c) / (h.c - l.c) * (h.a - l.a) AS area FROM low l JOIN high h USING (map_id, level))
        SELECT map_id, level, round(degrees(ra) + (ra < 0)::INT * 360, 6) AS ra, round(degrees(dec), 6) AS dec, round(n * sqrt((cxx + cyy) / 2 + sqrt(pow((cxx - cyy) / 2, 2) + cxy * cxy)), 5) AS a, round(n * sqrt((cxx + cyy) / 2 - sqrt(pow((cxx - cyy) / 2, 2) + cxy * cxy)), 5) AS b,
            round(180 - degrees(atan2(2 * cxy, cxx - cyy)) / 2 - 180 * floor((180 - degrees(atan2(2 * cxy, cxx - cyy)) / 2) / 180), 5) AS pa, round(area, 5) AS area FROM hit JOIN centre USING (map_id) JOIN k2 USING (map_id)"""


@query(_ellipse_sql())
def find_ellipse(spark, sf_dir):
    """Ellipses of four maps, weighed towards one direction."""
    a = ix.uniq2ang(ix.nest2uniq(F.lit(2), F.col("ipix")))
    f = flat_map(spark, sf_dir).withColumn("a", a)
    towards = F.cos("a.theta") * np.cos(1.0) + F.sin("a.theta") * np.sin(1.0) * F.cos(F.col("a.phi") - 2)
    f = f.select("map_id", "ipix", (F.col("w") * F.exp(4 * towards)).alias("w"))
    m = f.join(f.groupBy("map_id").agg(F.sum("w").alias("total")), "map_id").select("map_id", "ipix", (F.col("w") / F.col("total")).alias("prob"))
    e = contours.find_ellipse(m, 2, [0.5, 0.9], ["map_id"])
    return e.select("map_id", "level", F.round("ra", 6).alias("ra"), F.round("dec", 6).alias("dec"), *[F.round(c, 5).alias(c) for c in ("a", "b", "pa", "area")])


@query(f"""WITH {GREEDY}, px AS (SELECT i, j, 2 * (i + 0.5::DOUBLE) / 60 - 1 AS u, asin(2 * (j + 0.5::DOUBLE) / 30 - 1) AS t FROM range(60) a(i), range(30) b(j)),
    sky_px AS (SELECT i, j, -u * pi() / cos(t) + (u > 0)::INT * 2 * pi() AS phi, (2 * t + sin(2 * t)) / pi() AS z FROM px WHERE abs(u) <= cos(t)),
    hit AS (SELECT * FROM {geo.lookup('sky_px', 3)}),
    own AS (SELECT hit.i, hit.j, c.map_id, round(w / all_w / (pi() / 3 * pow(0.25, ord)), 9) AS value FROM hit JOIN c ON c.ipix = hit.p // (CASE ord WHEN 2 THEN 4 ELSE 1 END))
    SELECT m.map_id, px.i AS x, px.j AS y, own.value AS probdensity, (own.value IS NOT NULL)::INT AS footprint FROM px CROSS JOIN range(4) m(map_id) LEFT JOIN own ON own.i = px.i AND own.j = px.j AND own.map_id = m.map_id""")
def reproject_image(spark, sf_dir):
    grid, cells = image.grid(spark, 60, 30, "MOL"), _density_map(spark, sf_dir)
    out = None
    for k in range(4):  # the fixture's maps
        own = image.reproject(grid, cells.where(F.col("map_id") == k), "probdensity").withColumn("map_id", F.lit(k).cast("long"))
        out = own if out is None else out.unionByName(own)
    return out.select("map_id", "x", "y", F.round("probdensity", 9).alias("probdensity"), "footprint")


_SITES = [("north", -118.0, 34.0), ("south", -70.0, -30.0)]


SEEN = f"""{GREEDY}, site AS (SELECT * FROM (VALUES ('north', -118.0::DOUBLE, 34.0::DOUBLE), ('south', -70.0, -30.0)) v(site, lon, lat)),
    cell AS (SELECT map_id, prob, z, phi FROM {geo.cells("(SELECT map_id, ord AS k, ipix AS p, w / all_w AS prob FROM c)")}),
    clock AS (SELECT *, unix / 86400 - 10957.5::DOUBLE AS d FROM (SELECT 1.5e9::DOUBLE + i * 14400 AS unix FROM range({{n}}) t(i))),
    sun AS (SELECT *, radians(280.459 + 0.98564736 * d + 1.915 * sin(radians(357.529 + 0.98560028 * d)) + 0.020 * sin(2 * radians(357.529 + 0.98560028 * d))) AS l, radians(23.439 - 0.00000036 * d) AS e,
        2 * pi() * (0.7790572732640 + 1.00273781191135448 * d) AS gmst FROM clock),
    seen AS (SELECT map_id, site, unix, prob, sin(radians(lat)) * z + cos(radians(lat)) * sqrt(1 - z * z) * cos(gmst + radians(lon) - phi) AS alt,
        sin(radians(lat)) * sin(e) * sin(l) + cos(radians(lat)) * sqrt(1 - pow(sin(e) * sin(l), 2)) * cos(gmst + radians(lon) - atan2(cos(e) * sin(l), cos(l))) AS sun_alt FROM cell, site, sun)"""


@query(f"""WITH {SEEN.replace('{n}', '6')} SELECT map_id, site, unix, round(sum(CASE WHEN alt > 0 AND 1 / alt <= 2.5 AND sun_alt < sin(radians(-18.0)) THEN prob ELSE 0 END) / sum(prob), 9) AS fraction FROM seen GROUP BY 1, 2, 3""")
def observability(spark, sf_dir):
    sites = spark.createDataFrame(_SITES, "site string, longitude double, latitude double")
    times = spark.range(6).select((1.5e9 + F.col("id") * 14400.0).alias("unix"))
    seen = visibility.observability(_density_map(spark, sf_dir), sites, times, keys=["map_id"])
    return seen.withColumn("fraction", F.round("fraction", 9))


@query(f"""WITH {SEEN.replace('{n}', '3')}, a AS (SELECT *, CASE WHEN alt > 0 THEN 1 / alt ELSE 'inf'::DOUBLE END AS airmass FROM seen),
    b AS (SELECT *, sum(prob) OVER (PARTITION BY map_id, site, unix ORDER BY airmass, prob ROWS UNBOUNDED PRECEDING) - prob AS before FROM a),
    f AS (SELECT *, before / max(before) OVER (PARTITION BY map_id, site, unix) AS place FROM b)
    SELECT map_id, site, unix, q, coalesce(round(max(airmass) FILTER (place <= q + 1e-12 AND airmass < 'inf'::DOUBLE), 2), 0) AS finite, bool_or(place <= q + 1e-12 AND airmass = 'inf'::DOUBLE) AS below
    FROM f, (SELECT unnest([0.05::DOUBLE, 0.5::DOUBLE, 0.95::DOUBLE]) AS q) GROUP BY 1, 2, 3, 4""")
def airmass_percentiles(spark, sf_dir):
    sites = spark.createDataFrame(_SITES, "site string, longitude double, latitude double")
    times = spark.range(3).select((1.5e9 + F.col("id") * 14400.0).alias("unix"))
    a = visibility.airmass(_density_map(spark, sf_dir), sites, times, keys=["map_id"])
    top = F.col("airmass") == float("inf")
    finite = _largest_finite(spark, sf_dir, sites, times)
    return a.join(finite, ["map_id", "site", "unix"]).select("map_id", "site", "unix", "q", F.round(F.when(top, F.col("largest")).otherwise(F.col("airmass")), 2).alias("finite"), top.alias("below"))


def _largest_finite(spark, sf_dir, sites, times):
    """The largest air mass above the horizon, for each map, site and time; 0 where nothing is up."""
    a = visibility.airmass(_density_map(spark, sf_dir), sites, times, [100.0], ["map_id"]).select("map_id", "site", "unix")
    seen = visibility.seen(_density_map(spark, sf_dir), sites, times).where("_alt > 0")
    top = seen.groupBy("map_id", "site", "unix").agg(F.max(1 / F.col("_alt")).alias("largest"))
    return a.join(top, ["map_id", "site", "unix"], "left").withColumn("largest", F.coalesce("largest", F.lit(0.0)))


# --- generators


def _samples(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(*[F.element_at("embedding", k).cast("double").alias(n) for k, n in ((1, "x"), (2, "y"), (3, "z"))])
    ra, dec = angles.to_spherical(F.col("x") + 2, "y", "z")
    return e.select(ra.alias("ra"), dec.alias("dec"), (100 * F.sqrt((F.col("x") + 2) ** 2 + F.col("y") ** 2 + F.col("z") ** 2)).alias("distance"))


@query()
def map_from_samples(spark, sf_dir):
    return density.from_samples(_samples(spark, sf_dir))


def _toy_events(spark, n: int = 2):
    """Events of two detectors with smooth series, made from their number alone."""
    t = (np.arange(61) - 30) / 512
    rows = []
    for k in range(n):
        singles = []
        for j, (loc, turn) in enumerate((([0.02, 0.0, 0.0], 0.0), ([0.0, 0.02, 0.005], 0.8 + 0.1 * k))):
            s = (10 + j) * np.exp(-((t / 0.02) ** 2)) * np.exp(1j * (0.3 + j))
            c, q = np.cos(turn), np.sin(turn)
            r = np.array([[c, 0, q], [0, 1, 0], [-q, 0, c]])
            d = r @ np.diag([0.5, -0.5, 0.0]) @ r.T
            singles.append((f"D{j}", 400.0, d.ravel().tolist(), loc, 1e9 - 30 / 512 + 0.004 * j, 512.0, s.real.tolist(), s.imag.tolist()))
        rows.append((str(k), singles))
    return spark.createDataFrame(rows, "event_id string, singles array<struct<detector:string,horizon:double,response:array<double>,location:array<double>,epoch:double,rate:double,snr_re:array<double>,snr_im:array<double>>>")


def _order_events(spark, sf_dir):
    """Two events of two detectors from all orders: finished ones and others, by the parity of the customer.

    A series has 61 samples about a peak; each is changed by the share of the value of the orders that fall on it.
    """
    o = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("event"), (F.col("o_custkey") % 2).cast("int").alias("j"), (F.col("o_orderkey") % 61).cast("int").alias("k"), cents("o_totalprice").alias("w"))
    w = o.groupBy("event", "j", "k").agg(F.sum("w").alias("w"))
    whole = w.groupBy("event", "j").agg(F.sum("w").alias("all"))
    grid = whole.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(60))))
    share = 61 * F.coalesce(F.col("w"), F.lit(0)) / F.col("all")
    size = (10 + F.col("j")) * F.exp(-F.pow((F.col("k") - 30) / 10.24, 2)) * (1 + 0.1 * (share - 1))
    phase = 0.3 + F.col("j")
    s = grid.join(w, ["event", "j", "k"], "left").select("event", "j", F.struct("k", (size * F.cos(phase)).alias("re"), (size * F.sin(phase)).alias("im")).alias("x"))
    s = s.groupBy("event", "j").agg(F.array_sort(F.collect_list("x")).alias("x"))  # 61 samples
    turn = F.when(F.col("j") == 0, 0.0).otherwise(0.8 + 0.1 * F.col("event"))
    c, q, none = F.cos(turn), F.sin(turn), F.lit(0.0)
    response = F.array(0.5 * c * c, none, -0.5 * c * q, none, F.lit(-0.5), none, -0.5 * c * q, none, 0.5 * q * q)
    location = F.when(F.col("j") == 0, F.array(F.lit(0.02), none, none)).otherwise(F.array(none, F.lit(0.02), F.lit(0.005)))
    single = F.struct(F.concat(F.lit("D"), F.col("j").cast("string")).alias("detector"), F.lit(400.0).alias("horizon"), response.alias("response"), location.alias("location"), (1e9 - 30 / 512 + 0.004 * F.col("j")).alias("epoch"), F.lit(512.0).alias("rate"), F.transform("x", lambda v: v["re"]).alias("snr_re"), F.transform("x", lambda v: v["im"]).alias("snr_im"))
    return s.groupBy(F.col("event").cast("string").alias("event_id")).agg(F.array_sort(F.collect_list(single)).alias("singles"))


@query()
def localize_events(spark, sf_dir):
    return localize.localize(_order_events(spark, sf_dir))


@query()
def sample_events(spark, sf_dir):
    return localize.sample_events(_order_events(spark, sf_dir).where("event_id = '0'"))


@query()
def inject_and_realize(spark, sf_dir):
    """Injections within reaches weighed by the customers of each region, five rows."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "customer"), F.col("n_nationkey") == F.col("c_nationkey"))
    k = F.col("n_regionkey")
    reach = n.groupBy("n_regionkey").agg(F.count(F.lit(1)).cast("double").alias("weight")).select((1 + 0.2 * k).alias("m1_low"), (1.2 + 0.2 * k).alias("m1_high"), F.lit(1.0).alias("m2_low"), (1.2 + 0.2 * k).alias("m2_high"), "weight", (0.05 + 0.004 * k).alias("z_max"))
    response = np.diag([0.5, -0.5, 0.0])
    return simulate.realize(simulate.inject(spark, 20, reach, 7), [{"ifo": "D0", "response": response, "location": [0.02, 0, 0], "psd": signal.model_psd}])


@query("""SELECT r_name AS ifo, k, CASE WHEN 32 * k >= 10 THEN round(log10(factor * factor * 1e-49 * (pow(x, -4.14) - 5 * pow(x, -2) + 111 * (1 - x * x + pow(x, 4) / 2) / (1 + x * x / 2))), 8) END AS log_power
    FROM (SELECT r_name, 1 + r_regionkey / 2.0::DOUBLE AS factor, k::INT AS k, greatest(32 * k, 1) / 215.0::DOUBLE AS x FROM region, range(65) t(k))""")
def model_spectra(spark, sf_dir):
    """A detector for each region, five rows."""
    own = {r.r_name: 1 + r.r_regionkey / 2 for r in table(spark, sf_dir, "region").collect()}
    s = simulate.model_spectra(spark, own, 32.0).select("ifo", F.posexplode("data").alias("k", "s"))
    return s.select("ifo", "k", F.when(F.col("s") < float("inf"), F.round(F.log10("s"), 8)).alias("log_power"))


#: E(z) of the cosmology at a redshift, and the comoving distance by Simpson's rule over 400 steps.
EFUNC = "sqrt(0.3075 * pow(1 + {z}, 3) + 9.18e-5 * pow(1 + {z}, 4) + (1 - 0.3075 - 9.18e-5))"
SIMPSON = "list_sum(list_transform(range(401), lambda i: (CASE WHEN i = 0 OR i = 400 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) / " + EFUNC.replace("{z}", "({z} * i / 400)") + ")) * {z} / 1200 * 299792.458 / 67.74"


@query(f"""WITH RECURSIVE c AS (SELECT c_custkey, abs(c_acctbal) + 1 AS d FROM customer),
    b AS (SELECT 0 AS step, c_custkey, d, 0::DOUBLE AS low, 4::DOUBLE AS high FROM c
        UNION ALL SELECT step + 1, c_custkey, d, CASE WHEN less THEN (low + high) / 2 ELSE low END, CASE WHEN less THEN high ELSE (low + high) / 2 END
        FROM (SELECT *, (1 + (low + high) / 2) * {SIMPSON.replace('{z}', '((low + high) / 2)')} < d AS less FROM b WHERE step < 36)),
    r AS (SELECT c_custkey, (low + high) / 2 AS z, {SIMPSON.replace('{z}', '((low + high) / 2)')} AS dc, 299792.458 / 67.74 / {EFUNC.replace('{z}', '((low + high) / 2)')} AS dh FROM b WHERE step = 36)
    SELECT c_custkey, round(z, 7) AS z, round(dh * dc * dc / ((dc + (1 + z) * dh) * pow((1 + z) * dc, 2)), 6) AS ratio FROM r""")
def cosmology_redshift(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.abs("c_acctbal") + 1).alias("d"))
    return c.select("c_custkey", F.round(cosmology.redshift("d"), 7).alias("z"), F.round(cosmology.volume_ratio("d"), 6).alias("ratio"))


@query("""WITH RECURSIVE c AS (SELECT count(*) AS n FROM supplier), b AS (SELECT 0 AS step, n, k, p, 0::DOUBLE AS low, 1::DOUBLE AS high FROM c, range(1, n + 1) t(k), (VALUES (0.025::DOUBLE), (0.975)) v(p)
        UNION ALL SELECT step + 1, n, k, p, CASE WHEN less THEN (low + high) / 2 ELSE low END, CASE WHEN less THEN high ELSE (low + high) / 2 END FROM (
            SELECT *, list_sum(list_transform(range(k, n + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n + 1 - j) + j * ln((low + high) / 2) + (n - j) * ln(1 - (low + high) / 2)))) < p AS less FROM b WHERE step < 40))
    SELECT k, round(max((low + high) / 2) FILTER (p < 0.5), 7) AS low, round(max((low + high) / 2) FILTER (p > 0.5), 7) AS high FROM b WHERE step = 40 GROUP BY k""")
def pp_band(spark, sf_dir):
    return stats.pp_band(table(spark, sf_dir, "supplier")).select("k", F.round("low", 7).alias("low"), F.round("high", 7).alias("high"))


@query("""SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def trigger_rate(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    w = windows.trigger_rate(e.withColumn("ts", F.col("ts").cast("timestamp")))
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


from . import extra  # noqa: E402, F401  registers more queries
