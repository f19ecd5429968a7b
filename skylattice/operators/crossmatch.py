"""Matching of catalogs and maps."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import distance as D
from ..functions import index as ix
from ..functions.angles import angle_distance
from ..storage import spill
from . import volumes
from .credible import DEG2, WHOLE_SKY, curve, interpolate
from .graph import components
from .modes import with_steps
from .prefix import cumulative_by_range


def locate(points: DataFrame, cells: DataFrame, keys: list[str] = []) -> DataFrame:
    """Points with the columns of the cell that holds each: an equi-join on ancestors, not a range join.

    ``points`` have ``p29`` (nested pixel at order 29), ``cells`` have ``uniq``.  A point is
    exploded to its ancestors at the orders that occur in ``cells`` (30 at most); as cells don't
    overlap, one of them matches at most.  Points outside all cells are left out.
    """
    orders = [r[0] for r in cells.select(ix.uniq2order("uniq").alias("o")).distinct().collect()]
    if not orders:
        return points.crossJoin(cells.limit(0).drop(*keys))
    o = F.explode(F.array(*[F.lit(int(x)) for x in sorted(orders)])).alias("_o")
    up = points.select("*", o)
    up = up.withColumn("uniq", ix.nest2uniq(F.col("_o"), F.call_function("shiftright", F.col("p29"), (2 * (29 - F.col("_o"))).cast("int")))).drop("_o")
    return up.join(cells, [*keys, "uniq"])


def find_floor(values: DataFrame, ladder: DataFrame, key: str = "x") -> DataFrame:
    """(x, floor): index of the last rung of ``ladder`` (key, at) not above x; -1 below the first.

    Rungs and values are merged by range, rungs are counted within each range and the totals of the ranges before it
    are added: an as-of join without a range join and without a sort in one task.
    """
    rungs = ladder.select(F.col("at").alias(key)).withColumn("_rung", F.lit(1))
    both = values.withColumn("_rung", F.lit(0)).unionByName(rungs, allowMissingColumns=True)
    out = cumulative_by_range(both, [], [F.col(key), F.desc("_rung")], {"_count": F.col("_rung")})
    return out.where("_rung = 0").select(*values.columns, (F.col("_count") - 1).cast("long").alias("floor"))


def catalog_points(catalog: DataFrame, ra: str = "ra", dec: str = "dec", z: str | None = None) -> DataFrame:
    """Add ``p29`` to a catalog of directions in radians; ``z`` names a column of the sine of dec, where the catalog has it exactly."""
    if z is not None:
        return catalog.withColumn("p29", ix.zphi2nest(F.lit(29), F.col(z), F.pmod(F.col(ra), F.lit(2 * math.pi))))
    return catalog.withColumn("p29", ix.ang2nest(F.lit(29), F.lit(math.pi / 2) - F.col(dec), F.pmod(F.col(ra), F.lit(2 * math.pi))))


def searched(df: DataFrame, catalog: DataFrame, keys: list[str] = [], density: str = "probdensity") -> DataFrame:
    """For every (map, object): searched area, probability and offset from the most probable cell.

    One prefix sum per map serves any number of objects; ``catalog`` has p29, ra, dec.
    """
    m = df.withColumn("_area", ix.uniq2pixarea("uniq") * DEG2).withColumn("_prob", F.col(density) * ix.uniq2pixarea("uniq"))
    c = curve(m, "_prob", F.col(density), F.col("_area"), keys)
    best = df.groupBy(*keys).agg(F.max_by("uniq", F.struct(F.col(density), -F.col("uniq"))).alias("_best")).withColumn("_a", ix.uniq2ang("_best"))
    best = best.select(*keys, F.col("_a.phi").alias("_ra"), (math.pi / 2 - F.col("_a.theta")).alias("_dec"))
    maps = c.select(*keys, "uniq", F.col(density).alias("probdensity"), F.col("cum_area").alias("searched_area"), F.col("cum_weight").alias("searched_prob"))
    hit = locate(catalog, maps, [k for k in keys if k in catalog.columns])
    hit = hit.join(best, keys) if keys else hit.crossJoin(F.broadcast(best))
    return hit.withColumn("offset", F.degrees(angle_distance("ra", "dec", "_ra", "_dec"))).drop("_ra", "_dec", "p29")


def area_probs(df: DataFrame, areas: list[float], keys: list[str] = [], density: str = "probdensity") -> DataFrame:
    """(keys, area, prob): greatest probability within an area of so many square degrees."""
    m = df.withColumn("_area", ix.uniq2pixarea("uniq") * DEG2).withColumn("_prob", F.col(density) * ix.uniq2pixarea("uniq"))
    c = curve(m, "_prob", F.col(density), F.col("_area"), keys)
    wanted = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(float(x)) for x in areas])).alias("area"))
    return interpolate(c, wanted, "cum_area", "cum_weight", "prev_area", "prev_weight", "area", keys, F.lit(1.0)).withColumnRenamed("cum_weight", "prob")


def count_modes(mask: DataFrame, order: int, keys: list[str] = []) -> DataFrame:
    """(keys, modes): connected components, over 8 neighbours, of a set of pixels (keys, ipix) at one order."""
    return count_modes_moc(mask.select(*keys, ix.nest2uniq(F.lit(order), F.col("ipix")).alias("uniq")), keys)


def count_modes_moc(cells: DataFrame, keys: list[str] = []) -> DataFrame:
    """The same for a set of multi-resolution cells (keys, uniq), as they are: the merge tree of a map of one density."""
    steps = with_steps(cells.select(*keys, "uniq").distinct().withColumn("_one", F.lit(1.0)), keys, "_one")
    return steps.groupBy(*keys).agg(F.coalesce(F.sum("modes_step"), F.lit(0)).cast("long").alias("modes"))


def contour_modes(df: DataFrame, contours: list[float], keys: list[str] = [], density: str = "probdensity") -> DataFrame:
    """(keys, level, modes) of the regions of several levels: the densest cells that hold no more than each."""
    m = with_steps(df, keys, density).withColumn("_prob", F.col(density) * ix.uniq2pixarea("uniq"))
    order = [F.col(density).desc(), F.col("uniq").asc()]
    run = cumulative_by_range(m, keys, order, {"_upto": F.col("_prob")})
    return _modes_within(run, "_upto", contours, keys)


def _modes_within(run: DataFrame, upto: str, contours: list[float], keys: list[str]) -> DataFrame:
    sums = [F.sum(F.when(F.col(upto) <= float(c), F.col("modes_step")).otherwise(0)) for c in contours]
    wide = run.groupBy(*keys).agg(F.array(*sums).alias("_m"))
    levels = F.array(*[F.lit(float(c)) for c in contours])
    return wide.select(*keys, F.explode(F.arrays_zip(levels.alias("level"), F.col("_m").alias("modes"))).alias("_x")).select(*keys, "_x.level", F.coalesce("_x.modes", F.lit(0)).cast("long").alias("modes"))


def flood_fill(mask: DataFrame, order: int, seed: int | DataFrame, keys: list[str] = []) -> DataFrame:
    """Pixels of the mask connected with ``seed`` (a pixel, or a table of keys and ipix).

    The component is found by labels that halve their chains, in rounds that grow with the logarithm of the region's width
    instead of one a ring; the plan doesn't grow.
    """
    cells = spill(mask.select(*keys, "ipix").distinct())
    seeds = cells.join(seed.select(*keys, "ipix"), [*keys, "ipix"], "left_semi") if isinstance(seed, DataFrame) else cells.where(F.col("ipix") == seed)
    near = cells.select(*keys, "ipix", F.explode(ix.neighbours(F.lit(order), F.col("ipix"))).alias("_n")).where("_n > ipix")
    pairs = near.join(cells.withColumnRenamed("ipix", "_n"), [*keys, "_n"])
    node = lambda p: F.struct(*[F.col(k).alias(k) for k in keys], F.col(p).alias("ipix"))
    roots = components(pairs.select(node("ipix").alias("u"), node("_n").alias("v")))
    flat = roots.select(*[F.col(f"node.{k}").alias(k) for k in keys], F.col("node.ipix").alias("ipix"), F.col("root.ipix").alias("_root"))
    own = flat.join(seeds, [*keys, "ipix"], "left_semi").select(*keys, "_root").distinct()
    return flat.join(own, [*keys, "_root"], "left_semi").select(*keys, "ipix").unionByName(seeds).distinct()


def _reach(df: DataFrame, catalog: DataFrame | None, keys: list[str]) -> DataFrame:
    """(keys, max_r): six times the marginal mean distance of each map, or as far as its farthest object."""
    from .moments import marginal_moments

    prob = df.withColumn("prob", F.col("probdensity") * ix.uniq2pixarea("uniq"))
    mean = marginal_moments(prob, keys).select(*keys, (6 * F.col("distmean")).alias("max_r"))
    if catalog is None:
        return mean
    own = [k for k in keys if k in catalog.columns]
    far = catalog.groupBy(*own).agg(F.max("distance").alias("_far"))
    both = mean.join(far, own, "left") if own else mean.crossJoin(F.broadcast(far))
    return both.select(*keys, F.greatest("max_r", F.coalesce("_far", F.lit(0.0))).alias("max_r"))


def contour_volumes(df: DataFrame, contours: list[float], keys: list[str] = [], n_r: int = 999, cosmology: bool = False) -> DataFrame:
    """(keys, level, volume): volume of the smallest region of space that holds each level, for maps without targets."""
    cells = spill(volumes.cells_of(df, _reach(df, None, keys), keys, n_r))
    return volumes.volumes_at(cells, contours, keys, n_r, cosmology)


def searched_volume(df: DataFrame, catalog: DataFrame, contours: list[float] = [], keys: list[str] = [], n_r: int = 999, cosmology: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """3-D cross-match: (objects with searched_vol, searched_prob_vol, probdensity_vol and searched_prob_dist; contour volumes, None without ``contours``).

    Shells reach six times the map's marginal mean distance, or the farthest object.  An object's voxel is its cell in the shell at or
    below its distance.  searched_prob_dist is the marginal distribution over the whole sky.  ``cosmology`` ranks by probability per comoving volume, and volumes
    are comoving.
    """
    df = spill(df)  # read by every branch
    reach = spill(_reach(df, catalog, keys))
    cells = spill(volumes.cells_of(df, reach, keys, n_r))
    own = [k for k in keys if k in catalog.columns]
    placed = spill(catalog.withColumn("_target", F.monotonically_increasing_id()))
    found = _in_space(placed.select("_target", "p29", "distance", *own), cells, marginal_grid(df, reach, [], keys, n_r), keys, n_r, cosmology)
    objects = placed.join(found.drop(*own), "_target").drop("_target", "p29")
    names = [*[c for c in catalog.columns if c != "p29"], *[k for k in keys if k not in own]]
    return objects.select(*names, "searched_vol", "searched_prob_vol", "probdensity_vol", "searched_prob_dist"), volumes.volumes_at(cells, contours, keys, n_r, cosmology) if contours else None


def _in_space(targets: DataFrame, cells: DataFrame, grid: DataFrame, keys: list[str], n_r: int, cosmology: bool) -> DataFrame:
    """(_target, keys, searched_vol, searched_prob_vol, probdensity_vol, searched_prob_dist) of ``targets`` (_target, p29, distance)."""
    hit = locate(targets, cells, [k for k in keys if k in targets.columns])
    hit = hit.join(grid, keys) if keys else hit.crossJoin(F.broadcast(grid))
    hit = hit.withColumn("_shell", volumes.shell_of(F.col("distance"), F.col("_step"), n_r))
    z = (F.col("_step") * F.col("_shell") - F.col("distmu")) / F.col("distsigma")
    rate = F.col("_log") - F.lit(0.5) * z * z
    if cosmology:
        rate = rate - F.element_at("ln_ratio", F.col("_shell"))
    # the curve of the marginal distribution, from (0, 0)
    r, k = F.col("distance"), F.floor(F.col("distance") / F.col("_step")).cast("int")
    at = lambda i: F.when(i <= 0, 0.0).otherwise(F.get("cdf", i - 1))
    line = at(k) + (r / F.col("_step") - k) * (at(k + 1) - at(k))
    along = F.when(r <= 0, 0.0).when(r > F.col("_step") * n_r, 1.0).when(k >= n_r, F.get("cdf", F.lit(n_r - 1))).otherwise(line)
    hit = spill(hit.select("_target", *keys, rate.alias("rate"), along.alias("searched_prob_dist")))
    above = volumes.sums_above(cells, hit, keys, n_r, cosmology)
    on = [hit[k].eqNullSafe(above[k]) for k in keys] + [hit["rate"] == above["rate"]]
    return hit.join(above, on, "left").select("_target", *[hit[k] for k in keys], F.col("cum_v").alias("searched_vol"), F.col("cum_p").alias("searched_prob_vol"), F.exp(hit["rate"]).alias("probdensity_vol"), "searched_prob_dist")


def marginal_grid(df: DataFrame, reach: DataFrame, contours: list[float], keys: list[str], n_r: int = 999) -> DataFrame:
    """(keys, cdf, ln_ratio, widths): the marginal distribution of distance on the shells of every map (``n_r`` numbers), the comoving volume
    of each, and the widths of the central intervals of ``contours``, infinite beyond the shells."""
    from ..functions.types import fields
    from .moments import _type

    names = ("prob", "distmu", "distsigma", "distnorm")
    prob = df.withColumn("prob", F.col("probdensity") * ix.uniq2pixarea("uniq"))
    plain = prob.select(*keys, *[F.col(c).cast("double") for c in names])
    plain = plain.join(reach, keys) if keys else plain.crossJoin(F.broadcast(reach))
    own = "".join(f"{k}:{_type(df, k)}," for k in keys)

    def partial(batches):
        for b in batches:
            for key, rows in b.groupby(keys, dropna=False) if keys else [((), b)]:
                r = rows["max_r"].iloc[0] / (n_r + 1) * np.arange(1, n_r + 1)
                p, mu, sigma, norm = (rows[c].to_numpy(float)[:, None] for c in names)
                total = np.zeros(n_r)
                for i in range(0, len(rows), 512):
                    s = slice(i, i + 512)
                    total += (p[s] * D.cdf(r[None, :], mu[s], sigma[s], norm[s])).sum(axis=0)
                yield pd.DataFrame({**{c: [x] * n_r for c, x in zip(keys, key)}, "max_r": rows["max_r"].iloc[0], "k": np.arange(n_r), "v": total})

    def shape(rows: pd.DataFrame) -> pd.DataFrame:  # n_r rows of a map
        step = float(rows["max_r"].iloc[0]) / (n_r + 1)
        cdf = rows.sort_values("k")["v"].to_numpy(float)
        r = np.concatenate(([0.0], step * np.arange(1, n_r + 1)))
        c = np.asarray(contours, float)
        low, high = (np.interp(x, np.concatenate(([0.0], cdf)), r, right=np.inf) for x in ((1 - c) / 2, (1 + c) / 2))
        with np.errstate(invalid="ignore"):
            return pd.DataFrame([{**{k: rows[k].iloc[0] for k in keys}, "cdf": cdf.tolist(), "ln_ratio": volumes.ln_ratio(step, n_r).tolist(), "widths": (high - low).tolist()}])

    sums = plain.mapInPandas(partial, fields(own + "max_r:double,k:int,v:double")).groupBy(*keys, "max_r", "k").agg(F.sum("v").alias("v"))
    return spill(sums.groupBy(*keys).applyInPandas(shape, fields(own + "cdf:array<double>,ln_ratio:array<double>,widths:array<double>")))


RESULT = ("searched_area", "searched_prob", "offset", "searched_modes", "contour_areas", "area_probs", "contour_modes", "searched_prob_dist", "contour_dists", "searched_vol", "searched_prob_vol", "contour_vols", "probdensity", "probdensity_vol")


def crossmatch(df: DataFrame, catalog: DataFrame, contours: list[float] = [0.5, 0.9], areas: list[float] = [100.0], modes: bool = False, keys: list[str] = [], n_r: int = 999, cosmology: bool = False) -> DataFrame:
    """All of ``RESULT`` for every map and object in one table: catalog columns, keys, and the 14 outputs.

    ``df`` has (keys, uniq, probdensity) and, for the outputs in three dimensions, distmu, distsigma, distnorm; ``catalog`` has p29, ra, dec and, for
    them, distance.  What a map or catalog can't give is null.  contour_areas, area_probs, contour_modes, contour_dists (widths of central intervals) and contour_vols
    are arrays in the order of ``contours`` and ``areas``.  Levels that a map doesn't reach have the area of the whole sky and an infinite volume.

    searched_modes counts the modes of the cells ranked up to the object's own, contour_modes those of the cells that hold no more than each
    level; both are read off one running sum.  ``cosmology`` ranks space by probability per comoving volume.
    """
    # both are read by every branch: once from where they come, then from the shared folder
    df, catalog = spill(df), spill(catalog.withColumn("_target", F.monotonically_increasing_id()))
    deep, far = "distmu" in df.columns, "distance" in catalog.columns
    own = [k for k in keys if k in catalog.columns]
    none = lambda t: F.lit(None).cast(t)

    def with_maps(out: DataFrame, more: DataFrame) -> DataFrame:
        return out.join(more, keys, "left") if keys else out.crossJoin(F.broadcast(more))

    def listed(rows: DataFrame, by: str, value, wanted, name: str) -> DataFrame:
        held = rows.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(by, value))).alias("_m"))
        return held.select(*keys, F.array(*[F.element_at("_m", F.lit(float(x))) for x in wanted]).alias(name))

    flat = df.select(*keys, "uniq", "probdensity")
    m = with_steps(flat, keys) if modes else flat.withColumn("modes_step", F.lit(0))
    m = m.withColumn("_prob", F.col("probdensity") * ix.uniq2pixarea("uniq")).withColumn("_area", ix.uniq2pixarea("uniq") * DEG2)
    order = [F.col("probdensity").desc(), F.col("uniq").asc()]
    c = spill(cumulative_by_range(m, keys, order, {"cum_weight": F.col("_prob"), "cum_area": F.col("_area"), "cum_modes": F.col("modes_step")}))
    c = c.withColumn("prev_weight", F.col("cum_weight") - F.col("_prob")).withColumn("prev_area", F.col("cum_area") - F.col("_area"))
    wanted = lambda values, name: df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(float(x)) for x in values])).alias(name))
    a = interpolate(c, wanted(contours, "level"), "cum_weight", "cum_area", "prev_weight", "prev_area", "level", keys, F.lit(WHOLE_SKY)) if contours else None
    p = interpolate(c, wanted(areas, "area"), "cum_area", "cum_weight", "prev_area", "prev_weight", "area", keys, F.lit(1.0)) if areas else None

    best = df.groupBy(*keys).agg(F.max_by("uniq", F.struct(F.col("probdensity"), -F.col("uniq"))).alias("_best")).withColumn("_a", ix.uniq2ang("_best"))
    best = best.select(*keys, F.col("_a.phi").alias("_ra"), (math.pi / 2 - F.col("_a.theta")).alias("_dec"))
    hit = locate(catalog, c.select(*keys, "uniq", F.col("probdensity").alias("_density"), "cum_weight", "cum_area", "cum_modes"), own)
    hit = hit.join(best, keys) if keys else hit.crossJoin(F.broadcast(best))
    searched_modes = F.col("cum_modes").cast("long") if modes else none("bigint")
    more = [F.col("cum_area").alias("searched_area"), F.col("cum_weight").alias("searched_prob"), F.degrees(angle_distance("ra", "dec", "_ra", "_dec")).alias("offset"), searched_modes.alias("searched_modes"), F.col("_density").alias("probdensity")]
    out = hit.select(*[x for x in catalog.columns if x != "p29"], *[k for k in keys if k not in own], *more)
    out = with_maps(out, listed(a, "level", F.col("cum_area"), contours, "contour_areas")) if contours else out.withColumn("contour_areas", F.array().cast("array<double>"))
    out = with_maps(out, listed(p, "area", F.col("cum_weight"), areas, "area_probs")) if areas else out.withColumn("area_probs", F.array().cast("array<double>"))
    if modes and contours:
        out = with_maps(out, listed(_modes_within(c, "cum_weight", contours, keys), "level", F.col("modes"), contours, "contour_modes"))
    else:
        out = out.withColumn("contour_modes", none("array<bigint>"))
    if deep:
        reach = spill(_reach(df, catalog if far else None, keys))
        cells = spill(volumes.cells_of(df, reach, keys, n_r))
        grid = marginal_grid(df, reach, contours, keys, n_r)
        out = with_maps(out, grid.select(*keys, F.col("widths").alias("contour_dists")))
        out = with_maps(out, listed(volumes.volumes_at(cells, contours, keys, n_r, cosmology), "level", F.col("volume"), contours, "contour_vols")) if contours else out.withColumn("contour_vols", F.array().cast("array<double>"))
    else:
        out = out.withColumn("contour_dists", none("array<double>")).withColumn("contour_vols", none("array<double>"))
    three = ("searched_prob_dist", "searched_vol", "searched_prob_vol", "probdensity_vol")
    if deep and far:
        found = _in_space(catalog.select("_target", "p29", "distance", *own), cells, grid, keys, n_r, cosmology)
        out = out.join(found.drop(*own), ["_target", *[k for k in keys if k not in own]], "left")
    else:
        for x in three:
            out = out.withColumn(x, none("double"))
    return out.select(*[x for x in catalog.columns if x not in ("p29", "_target")], *[k for k in keys if k not in own], *RESULT)


def distance_intervals(df: DataFrame, contours: list[float], keys: list[str] = []) -> DataFrame:
    """(keys, level, low, high): central intervals of the marginal distance that hold each level, all found together."""
    from .moments import marginal_quantiles

    ends = sorted({(1 - c) / 2 for c in contours} | {(1 + c) / 2 for c in contours})
    q = marginal_quantiles(df, ends, keys)
    level = F.explode(F.array(*[F.struct(F.lit(float(c)).alias("level"), F.lit(ends.index((1 - c) / 2)).alias("a"), F.lit(ends.index((1 + c) / 2)).alias("b")) for c in contours])).alias("c")
    wide = q.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", "distance"))).alias("q"))
    wide = wide.select(*keys, "q", level)
    return wide.select(*keys, F.col("c.level").alias("level"), F.element_at("q", F.col("c.a") + 1)["distance"].alias("low"), F.element_at("q", F.col("c.b") + 1)["distance"].alias("high"))


def stats(df: DataFrame, catalog: DataFrame | None = None, contours: list[float] = [0.5, 0.9], areas: list[float] = [100.0], modes: bool = False, keys: list[str] = ["map_id"]) -> DataFrame:
    """One row per map (and object): searched area, probability and offset, contour areas, area probabilities, modes."""
    from . import credible

    df = spill(df)  # read by every branch
    a = credible.areas(df, contours, keys, right=credible.WHOLE_SKY).groupBy(*keys).pivot("level", contours).agg(F.first("area"))
    a = a.select(*keys, *[F.col(f"`{c}`").alias(f"area({100 * c:g})") for c in contours])
    p = area_probs(df, areas, keys).groupBy(*keys).pivot("area", areas).agg(F.first("prob"))
    out = a.join(p.select(*keys, *[F.col(f"`{x}`").alias(f"prob({x:g})") for x in areas]), keys)
    if modes:
        m = contour_modes(df, contours, keys).groupBy(*keys).pivot("level", contours).agg(F.first("modes"))
        out = out.join(m.select(*keys, *[F.col(f"`{c}`").alias(f"modes({100 * c:g})") for c in contours]), keys, "left")
    return out if catalog is None else searched(df, catalog, keys).join(out, keys)


def crossmatch_numpy(uniq: np.ndarray, density: np.ndarray, p29: np.ndarray) -> pd.DataFrame:
    """The same on arrays of one map, for use within a grouped function."""
    order = (np.floor(np.log2(uniq.astype(float) * (1 + 1e-12))).astype(int) // 2) - 1
    ipix = uniq - 4 ** (order + 1)
    start = ipix << (2 * (29 - order))
    by = np.argsort(start)
    cell = by[np.searchsorted(start[by], p29, "right") - 1]
    rank = np.lexsort((uniq, -density))
    area = np.pi / 3 * 0.25**order
    cum_a, cum_p = np.empty(len(uniq)), np.empty(len(uniq))
    cum_a[rank], cum_p[rank] = np.cumsum(area[rank]) * DEG2, np.cumsum((area * density)[rank])
    return pd.DataFrame({"searched_area": cum_a[cell], "searched_prob": cum_p[cell], "probdensity": density[cell]})
