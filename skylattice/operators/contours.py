"""Contours of maps as rings of pixel corners, and the ellipse that fits a map's bulk."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import healpix
from ..functions import index as ix
from ..functions.polygon import simplify as simplify_polygon
from ..functions.types import fields, vectorized
from ..storage import spill
from .prefix import cumulative_by_range

#: Places of the corners of a side within a pixel, by the side's number: its start, with the region on one hand all along.
_CORNERS = {0: (0, 0), 1: (0, 1), 2: (1, 1), 3: (1, 0)}
#: A triangle below this share of a pixel is simplified away.
LEAST_TRIANGLE = 0.4


def _corner(at: int) -> Column:
    """A corner's name: the pixels that meet there.  Three do at some corners, four at all others."""
    n = F.col("_near")
    some = F.array(F.col("ipix"), n[(at - 1) % 8], n[at % 8], n[(at + 1) % 8])
    return F.array_sort(F.array_distinct(F.filter(some, lambda x: x >= 0)))


def boundary_edges(levels_df: DataFrame, order: int, levels: list[float], keys: list[str] = []) -> DataFrame:
    """(keys, level, ipix, side, neighbour, start, end): sides of pixels with cls <= level against one above it, or against none.

    ``side`` is 0 to 3; corners are named by the pixels that meet there, so that they are equal wherever they are seen from.
    """
    around = levels_df.select(*keys, "ipix", "cls", ix.neighbours(F.lit(order), F.col("ipix")).alias("_near"))
    # side 2 k lies between the corners 2 k - 1 and 2 k + 1
    sides = F.explode(F.array(*[F.struct(F.lit(k).alias("side"), F.col("_near")[2 * k].alias("neighbour"), _corner(2 * k - 1).alias("start"), _corner(2 * k + 1).alias("end")) for k in range(4)]))
    near = around.select(*keys, "ipix", "cls", sides.alias("_s")).select(*keys, "ipix", "cls", "_s.*")
    other = levels_df.select(*keys, F.col("ipix").alias("neighbour"), F.col("cls").alias("_other"))
    pairs = near.join(other, [*keys, "neighbour"], "left").withColumn("_other", F.coalesce("_other", F.lit(float("inf"))))
    wanted = F.filter(F.array(*[F.lit(float(x)) for x in levels]), lambda x: (F.col("cls") <= x) & (F.col("_other") > x))
    return pairs.select(*keys, F.explode(wanted).alias("level"), "ipix", "side", "neighbour", "start", "end")


def _chains(rows: pd.DataFrame) -> pd.DataFrame:
    """Sides (id, succ) of one block as chains: (id, chain, offset, closed, next, length, low).  The last three stand at a chain's first side."""
    ids, succ = rows["id"].to_numpy(np.int64), rows["succ"].to_numpy(np.int64)
    by = np.argsort(ids)
    ids, succ = ids[by], succ[by]
    at = np.minimum(np.searchsorted(ids, succ), len(ids) - 1)
    then = np.where(ids[at] == succ, at, -1).tolist()
    entered = np.zeros(len(ids), bool)
    entered[[k for k in then if k >= 0]] = True
    chain, offset, seen = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
    closed, head = np.zeros(len(ids), bool), {}
    # open chains first; what is left then is closed, and begins at its smallest side
    for first in [*np.flatnonzero(~entered).tolist(), *range(len(ids))]:
        if seen[first]:
            continue
        path, k = [], first
        while k >= 0 and not seen[k]:
            seen[k] = True
            path.append(k)
            k = then[k]
        chain[path], offset[path], closed[path] = ids[first], np.arange(len(path)), k == first
        head[first] = (None if k == first else int(succ[path[-1]]), len(path), int(ids[path].min()))
    more = [head.get(k, (None, None, None)) for k in range(len(ids))]
    out = pd.DataFrame({"id": ids, "chain": chain, "offset": offset, "closed": closed})
    for c, name in enumerate(("next", "length", "low")):
        out[name] = pd.array([x[c] for x in more], dtype="Int64")
    return out


def rings(edges: DataFrame, order: int, keys: list[str] = [], inner: int = 6, most_rounds: int = 64) -> DataFrame:
    """(keys, level, ring, nth, ipix, side): the sides of a boundary in the order of their closed rings.

    Where two pixels of a region meet at a corner only, each keeps to its own ring.  A ring is named by its smallest side (4 * ipix + side), and
    begins there.  Within blocks of 4^inner pixels sides are followed into chains; chains that leave their block are found and ranked by pointer doubling, in rounds
    that grow with the logarithm of their number along a ring.  No ring is gathered.
    """
    own = [*keys, "level"]
    kinds = {k: {"bigint": "long"}.get(t, t) for k, t in edges.dtypes}
    e = spill(edges.select(*own, (F.col("ipix") * 4 + F.col("side")).alias("id"), "ipix", "start", "end"))
    then = e.select(*own, F.col("start").alias("end"), F.col("id").alias("_id"), F.col("ipix").alias("_ipix"))
    after = e.join(then, [*own, "end"]).groupBy(*own, "id").agg(F.min_by("_id", F.struct(F.col("_ipix") != F.col("ipix"), F.col("_id"))).alias("succ"))
    after = after.withColumn("_block", F.call_function("shiftright", F.col("id"), F.lit(2 + 2 * min(inner, order))))

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        out = _chains(rows)
        for c in reversed(own):
            out.insert(0, c, rows[c].iloc[0])
        return out

    names = "".join(f"{k}:{kinds[k]}," for k in own) + "id:long,chain:long,offset:long,closed:boolean,next:long,length:long,low:long"
    told = spill(after.groupBy(*own, "_block").applyInPandas(one, fields(names)))
    place = [F.floor(F.col("id") / 4).cast("long").alias("ipix"), (F.col("id") % 4).cast("int").alias("side")]
    inside = told.where("closed").select(*own, F.col("chain").alias("ring"), F.col("offset").alias("nth"), *place)
    chains = told.where("not closed and length is not null").select(*own, F.col("chain").alias("id"), "next", "length", "low")
    if not chains.head(1):
        return inside
    state = chains
    for _ in range(most_rounds):
        far = state.select(*own, F.col("id").alias("next"), F.col("next").alias("_next"), F.col("low").alias("_low"))
        state = spill(state.join(far, [*own, "next"]).select(*own, "id", F.col("_next").alias("next"), F.least("low", "_low").alias("low"), (F.col("_low") < F.col("low")).alias("_changed")))
        if not state.where("_changed").head(1):
            break
        state = state.drop("_changed")
    ring = spill(chains.drop("low").join(state.select(*own, "id", F.col("low").alias("ring")), [*own, "id"]))
    # every ring is cut before its smallest chain; what is left up to the cut is added up
    first = ring.groupBy(*own, "ring").agg(F.min("id").alias("_first"), F.sum("length").alias("_all"))
    steps = ring.join(first, [*own, "ring"]).select(*own, "id", "ring", "_all", F.when(F.col("next") != F.col("_first"), F.col("next")).alias("next"), F.col("length").alias("left"))
    steps = spill(steps)
    for _ in range(most_rounds):
        going = steps.where("next is not null")
        if not going.head(1):
            break
        far = steps.select(*own, F.col("id").alias("next"), F.col("next").alias("_next"), F.col("left").alias("_left"))
        going = going.join(far, [*own, "next"]).select(*own, "id", "ring", "_all", F.col("_next").alias("next"), (F.col("left") + F.col("_left")).alias("left"))
        steps = spill(going.unionByName(steps.where("next is null")))
    placed = told.where("not closed").select(*own, "id", "chain", "offset").join(steps.select(*own, F.col("id").alias("chain"), "ring", "_all", "left"), [*own, "chain"])
    placed = placed.withColumn("_at", F.col("_all") - F.col("left") + F.col("offset"))
    start = placed.where("id = ring").select(*own, "ring", F.col("_at").alias("_start"))
    open_ = placed.join(start, [*own, "ring"]).select(*own, "ring", F.pmod(F.col("_at") - F.col("_start"), F.col("_all")).alias("nth"), *place)
    return inside.unionByName(open_)


def corner_angles(order: int):
    """UDF (ipix, side) -> (ra, dec) in degrees of the corner at which a side starts."""

    @vectorized("struct<ra:double,dec:double>")
    def angles(ipix: pd.Series, side: pd.Series) -> pd.DataFrame:
        dx, dy = (np.array([_CORNERS[k][j] for k in range(4)], float)[side.to_numpy(int)] for j in (0, 1))
        theta, phi = healpix.pix2ang(order, ipix.to_numpy(np.int64), dx, dy)
        return pd.DataFrame({"ra": np.degrees(phi) % 360, "dec": 90 - np.degrees(theta)})

    return angles


def polygons(levels_df: DataFrame, order: int, levels: list[float], keys: list[str] = [], simplify: bool = True) -> DataFrame:
    """(keys, level, polygons): arrays of rings of (ra, dec) in degrees around the regions of each level.

    ``levels_df`` has (keys, ipix, cls).  With ``simplify`` vertices of triangles below ``LEAST_TRIANGLE`` of a pixel go, ring by ring.
    """
    parts = rings(boundary_edges(levels_df, order, levels, keys), order, keys)
    points = parts.select(*keys, "level", "ring", "nth", corner_angles(order)("ipix", "side").alias("p")).select(*keys, "level", "ring", "nth", "p.ra", "p.dec")
    kinds = {k: {"bigint": "long"}.get(t, t) for k, t in levels_df.dtypes}
    out = fields("".join(f"{k}:{kinds[k]}," for k in keys) + "level:double,ring:long,polygon:array<struct<ra:double,dec:double>>")
    least = LEAST_TRIANGLE * np.pi / 3 * 0.25**order

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("nth")
        ra, dec = (np.radians(rows[c].to_numpy(float)) for c in ("ra", "dec"))
        path = np.stack([np.cos(dec) * np.cos(ra), np.cos(dec) * np.sin(ra), np.sin(dec)], axis=1)
        if simplify:
            path = simplify_polygon(path, least)
        found = [{"ra": float(np.degrees(np.arctan2(v[1], v[0])) % 360), "dec": float(np.degrees(np.arcsin(np.clip(v[2], -1, 1))))} for v in [*path, path[0]]]
        return pd.DataFrame([[*key, found]], columns=out.names)

    each = points.groupBy(*keys, "level", "ring").applyInPandas(one, out)
    packed = each.groupBy(*keys, "level").agg(F.array_sort(F.collect_list(F.struct("ring", "polygon"))).alias("_p"))
    return packed.select(*keys, "level", F.transform("_p", lambda x: x["polygon"]).alias("polygons"))


def contour(prob: DataFrame, order: int, levels: list[float], keys: list[str] = [], interpolate: str = "nearest", order_out: int | None = None, simplify: bool = True) -> DataFrame:
    """(keys, level, polygons) of a map of probabilities (keys, ipix, prob) at one order.

    ``interpolate``: ``nearest`` takes pixels as they are, ``nested`` smooths pixels that only repeat their parent, ``bilinear`` resamples to
    ``order_out`` by bilinear interpolation; the others resample by copying or adding.
    """
    from . import maps
    from .credible import greedy_levels

    if interpolate not in ("nearest", "nested", "bilinear"):
        raise ValueError(f"unknown interpolation {interpolate}")
    m, at = prob.select(*keys, "ipix", F.col("prob").cast("double").alias("prob")), order
    if order_out is not None and order_out != order:
        at = order_out
        if interpolate == "bilinear":
            m = maps.smooth_ud_grade(m, order, order_out, keys)
        elif order_out > order:
            step = 4 ** (order_out - order)
            m = m.select(*keys, F.explode(F.sequence(F.col("ipix") * step, F.col("ipix") * step + step - 1)).alias("ipix"), (F.col("prob") / step).alias("prob"))
        else:
            m = m.groupBy(*keys, ix.ancestor("ipix", order - order_out).alias("ipix")).agg(F.sum("prob").alias("prob"))
    if interpolate == "nested":
        m = maps.interpolate_nested(m.withColumnRenamed("prob", "value"), at, keys).withColumnRenamed("value", "prob")
    levelled = greedy_levels(spill(m), "prob", keys, tie="ipix", by_range=True)
    return polygons(levelled.select(*keys, "ipix", "cls"), at, levels, keys, simplify)


def geojson(polys: DataFrame, keys: list[str] = []) -> DataFrame:
    """(keys, json): a FeatureCollection with a MultiLineString for each level."""
    line = F.transform("polygons", lambda r: F.transform(r, lambda p: F.array(p["ra"], p["dec"])))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct((F.col("level") * 100).alias("credible_level")).alias("properties"), F.struct(F.lit("MultiLineString").alias("type"), line.alias("coordinates")).alias("geometry"))
    packed = polys.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("level", feature.alias("f")))).alias("_f"))
    return packed.select(*keys, F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.transform("_f", lambda x: x["f"]).alias("features"))).alias("json"))


#: Distance from the centre in the plane, in degrees, by the angle r from it in radians: zenithal projections, and the angle that each reaches.
PROJECTIONS = {
    "ARC": (lambda r: F.degrees(r), np.pi),
    "TAN": (lambda r: F.degrees(F.tan(r)), np.pi / 2 - 1e-12),
    "SIN": (lambda r: F.degrees(F.sin(r)), np.pi / 2 + 1e-12),
    "STG": (lambda r: 2 * F.degrees(F.tan(r / 2)), np.pi - 1e-12),
    "ZEA": (lambda r: 2 * F.degrees(F.sin(r / 2)), np.pi),
}


def find_ellipse(df: DataFrame, order: int | None = None, levels: list[float] = [0.9], keys: list[str] = [], projection: str = "ARC") -> DataFrame:
    """(keys, level, ra, dec, a, b, pa, area) in degrees: the ellipse about a map's bulk.

    ``df`` has (keys, ipix, prob) at one ``order``, or (keys, uniq, probdensity) of a multi-order map.  The centre is the direction of the weighted medians
    of the three coordinates; the covariance in a zenithal projection about it is taken in three rounds, each without the cells beyond
    3 sigma of any round before; sigmas are those about the centre.  The ellipse is blown up until it holds a level; a, b and area are NaN where the map
    holds less.  All steps are sums, or running sums by range: no map is gathered.
    """
    from .moments import weighted_quantile

    if projection not in PROJECTIONS:
        raise ValueError(f"{projection} isn't one of {', '.join(PROJECTIONS)}")
    plane, reach = PROJECTIONS[projection]
    if order is None:
        k, p = ix.uniq2nest("uniq")
        cells = df.select(*keys, "uniq", ix.nest2vec(k, p).alias("v"), ix.uniq2pixarea("uniq").alias("area"), F.col("probdensity").cast("double").alias("prob")).withColumn("prob", F.col("prob") * F.col("area"))
    else:
        cells = df.select(*keys, ix.nest2uniq(F.lit(order), F.col("ipix")).alias("uniq"), ix.nest2vec(F.lit(order), F.col("ipix")).alias("v"), F.lit(np.pi / 3 * 0.25**order).alias("area"), F.col("prob").cast("double").alias("prob"))
    # cells at one height or meridian tie, whatever the last digit says
    cells = spill(cells.select(*keys, "uniq", *[F.round(f"v.{c}", 13).alias(c) for c in "xyz"], F.degrees(F.degrees("area")).alias("area"), "prob"))
    join = lambda a, b: a.join(b, keys) if keys else a.crossJoin(F.broadcast(b))
    centre = None
    for c in ("x", "y", "z"):
        middle = weighted_quantile(cells, c, "prob", [0.5], keys).select(*keys, F.col(c).alias(f"c{c}"))
        centre = middle if centre is None else join(centre, middle)
    norm = F.sqrt(F.col("cx") ** 2 + F.col("cy") ** 2 + F.col("cz") ** 2)
    centre = spill(centre.select(*keys, F.atan2("cy", "cx").alias("ra"), F.asin(F.col("cz") / norm).alias("dec")))
    m = join(cells, centre)
    sin, cos = F.sin, F.cos
    along = F.col("x") * cos("dec") * cos("ra") + F.col("y") * cos("dec") * sin("ra") + F.col("z") * sin("dec")
    east = -F.col("x") * sin("ra") + F.col("y") * cos("ra")
    north = -F.col("x") * sin("dec") * cos("ra") - F.col("y") * sin("dec") * sin("ra") + F.col("z") * cos("dec")
    m = m.select(*keys, "uniq", "area", "prob", along.alias("_d"), east.alias("_e"), north.alias("_n")).withColumn("_h", F.hypot("_e", "_n")).withColumn("_r", F.atan2("_h", "_d"))
    scale = F.when(F.col("_h") > 0, plane(F.col("_r")) / F.col("_h")).otherwise(0.0)
    m = spill(m.where(F.col("_r") <= reach).select(*keys, "uniq", "area", "prob", (F.col("_e") * scale).alias("x"), (F.col("_n") * scale).alias("y")))
    kept, cov = m.withColumn("_keep", F.lit(True)), None
    for _ in range(3):
        w, x, y = (F.when(F.col("_keep"), F.col(c)) for c in ("prob", "x", "y"))
        s = kept.groupBy(*keys).agg(*[F.sum(v).alias(n) for n, v in (("w", w), ("ww", w * w), ("wx", w * x), ("wy", w * y), ("wxx", w * x * x), ("wxy", w * x * y), ("wyy", w * y * y))])
        part = lambda ab, a, b: (F.col(ab) - F.col(a) * F.col(b) / F.col("w")) / (F.col("w") - F.col("ww") / F.col("w"))
        cov = spill(s.select(*keys, part("wxx", "wx", "wx").alias("cxx"), part("wxy", "wx", "wy").alias("cxy"), part("wyy", "wy", "wy").alias("cyy")))
        det = F.col("cxx") * F.col("cyy") - F.col("cxy") ** 2
        square = (F.col("cyy") * F.col("x") ** 2 - 2 * F.col("cxy") * F.col("x") * F.col("y") + F.col("cxx") * F.col("y") ** 2) / det
        told = join(kept.drop("_sigma"), cov).withColumn("_sigma", F.sqrt(square))
        kept = told.withColumn("_keep", F.col("_keep") & (F.col("_sigma") < 3)).drop("cxx", "cxy", "cyy")
    run = cumulative_by_range(kept.select(*keys, "uniq", "_sigma", "prob", "area"), keys, [F.asc("_sigma"), F.asc("uniq")], {"_p": F.col("prob"), "_a": F.col("area")})
    point = F.struct("_p", "_sigma", "_a")
    ends = [f(F.when(on, point)).alias(f"{n}{k}") for k, level in enumerate(levels) for n, f, on in (("l", F.max, F.col("_p") <= float(level)), ("u", F.min, F.col("_p") > float(level)))]
    found = run.groupBy(*keys).agg(F.min(point).alias("first"), F.max("_p").alias("last"), *ends)

    def at(k: int, level: float, c: str) -> Column:
        low, high = F.col(f"l{k}"), F.col(f"u{k}")
        line = low[c] + (F.lit(float(level)) - low["_p"]) / (high["_p"] - low["_p"]) * (high[c] - low[c])
        return F.when(F.lit(float(level)) > F.col("last"), float("nan")).when(low.isNull(), F.col("first")[c]).when(high.isNull(), low[c]).otherwise(line)

    each = F.explode(F.array(*[F.struct(F.lit(float(v)).alias("level"), at(k, v, "_sigma").alias("n"), at(k, v, "_a").alias("area")) for k, v in enumerate(levels)]))
    rows = found.select(*keys, each.alias("e")).select(*keys, "e.*")
    rows = join(join(rows, centre), cov)
    half, spread = (F.col("cxx") + F.col("cyy")) / 2, F.hypot((F.col("cxx") - F.col("cyy")) / 2, F.col("cxy"))
    # the long axis stands at half the angle of (cxx - cyy, 2 cxy) from east; the position angle is counted from west over north
    turn = F.degrees(F.atan2(2 * F.col("cxy"), F.col("cxx") - F.col("cyy")) / 2)
    pa = F.pmod(180 - turn, F.lit(180.0))
    return rows.select(*keys, "level", F.pmod(F.degrees("ra"), F.lit(360.0)).alias("ra"), F.degrees("dec").alias("dec"), (F.col("n") * F.sqrt(half + spread)).alias("a"), (F.col("n") * F.sqrt(F.greatest(half - spread, F.lit(0.0)))).alias("b"), pa.alias("pa"), "area")
