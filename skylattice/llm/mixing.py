"""Mixing sources to target weights by cube-method balanced sampling.

A source whose target is r times its size gives each document floor(r) copies and one
more with probability r - floor(r).  Which documents get the extra copy is drawn by
the cube method: the flight phase moves the vector of inclusion probabilities along
directions of the null-space of the balancing constraints (tokens and documents)
until all but a few are 0 or 1.  Groups of bounded size fly on their own; what is left
fractional in each is regrouped and flies again, until one small landing problem per
source remains, which is solved by trying its few roundings.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import schema, spill, text_of, utf8_column

WEIGHTS = (5, 2, 1)
CAP = 3


def word_sizes(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(id, source, size, alike): the number of runs of anything but white space in the whole text, and a hash of it."""

    def count(batches):
        for batch in batches:
            data, offsets = utf8_column(batch.column(2))
            space = (data == 32) | ((data >= 9) & (data <= 13))
            first = ~space
            if len(data):
                first[1:] &= space[:-1]
                starts = offsets[:-1][offsets[:-1] < offsets[1:]]
                first[starts] = ~space[starts]
            upto = np.concatenate([[0], np.cumsum(first, dtype=np.int64)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(upto[offsets[1:]] - upto[offsets[:-1]]), batch.column(3)], ["id", "source", "size", "alike"])

    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"), F.xxhash64(text_of(text_col)).alias("alike"))
    return plain.mapInArrow(count, schema(("id", "long"), ("source", "string"), ("size", "long"), ("alike", "long")))


def targets(sizes: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, source_size, n, target), one row per source, from units (source, size, m rows alike); n counts units.

    The table of sources is small next to that of documents (a source is a name) and is ordered in one task.  Sources by code point, null last, take ``weights`` in turn.  Targets share the total
    size by weight; one above ``cap`` times its source's size stops there and the excess
    is shared again.  That ends at target = min(cap * size, level * weight) with one
    level for all: sources are capped in order of cap * size / weight.
    """
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count(F.lit(1)).alias("n"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("_most", cap * F.col("source_size").cast("double"))
    stop = Window.orderBy(F.col("_most") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = stop.rowsBetween(Window.unboundedPreceding, -1)
    onward = stop.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("_all", F.sum("source_size").over(whole))
    per = per.withColumn("_level", (F.col("_all") - F.coalesce(F.sum("_most").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    # the first source that isn't capped sets the level for all after it
    free = F.when(F.col("_level") * F.col("weight") < F.col("_most"), F.col("_level"))
    per = per.withColumn("_level", F.first(free, ignorenulls=True).over(stop.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.when(F.col("_level").isNull(), F.col("_most")).otherwise(F.least(F.col("_most"), F.col("_level") * F.col("weight")))
    return per.select("source", "source_size", "n", target.alias("target"))


def flight(chance: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move ``chance`` to 0 and 1 keeping sum(chance) and sum(chance * size); 2 at most stay between.

    Three fractional units at a time have a null direction of the two constraints; a
    step to either end is drawn so that every expectation stays as it was.
    """
    chance = chance.copy()
    eps = 1e-9
    waiting = [i for i in range(len(chance)) if eps < chance[i] < 1 - eps]
    held: list[int] = []
    for i in waiting:
        held.append(i)
        if len(held) < 3:
            continue
        a, b, c = (float(size[j]) for j in held)
        u = (b - c, c - a, a - b)
        if a == b == c:
            u = (1.0, -1.0, 0.0)
        up = down = np.inf
        for j, x in zip(held, u):
            p = chance[j]
            if x > 0:
                up, down = min(up, (1 - p) / x), min(down, p / x)
            elif x < 0:
                up, down = min(up, -p / x), min(down, (p - 1) / x)
        step = up if rng.random() < down / (up + down) else -down
        for j, x in zip(held, u):
            chance[j] = min(1.0, max(0.0, chance[j] + step * x))
        held = [j for j in held if eps < chance[j] < 1 - eps]
    done = np.ones(len(chance), bool)
    done[held] = False
    chance[done] = np.round(chance[done])
    return chance


def land(chance: np.ndarray, size: np.ndarray, wanted: float, flips: int = 8, fixed: np.ndarray | None = None) -> np.ndarray:
    """Round the few units that are still fractional so that sum(chance * size) comes nearest to ``wanted``.

    A large unit can be the last to stay open.  Its rounding error is then made up by
    at most ``flips`` single units, each time the one that brings the total nearest; ``fixed`` ones stay.
    """
    free = np.ones(len(chance), bool) if fixed is None else ~fixed
    left = np.flatnonzero((chance > 1e-9) & (chance < 1 - 1e-9))
    out = np.round(chance)
    base = float((np.delete(out, left) * np.delete(size, left)).sum()) - wanted
    out[left] = min(itertools.product((0, 1), repeat=len(left)), key=lambda x: (abs(base + float((np.array(x) * size[left]).sum())), x))
    error = float((out * size).sum()) - wanted
    for _ in range(flips):
        after = np.where(free, np.abs(error + np.where(out == 0, size, -size)), np.inf)
        k = int(after.argmin()) if len(after) else 0
        if not len(after) or after[k] >= abs(error):
            break
        error += size[k] if out[k] == 0 else -size[k]
        out[k] = 1 - out[k]
    return out


_UNIT = schema(("id", "long"), ("source", "string"), ("size", "long"), ("alike", "long"), ("m", "long"), ("source_size", "long"), ("target", "double"), ("base", "long"), ("chance", "double"), ("n", "long"))
#: Rows alike that one task writes out.
STEP = 10_000


def draw(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights=WEIGHTS, cap: float = CAP, group: int = 4096) -> DataFrame:
    """One row per unit: id, source, size, alike (a hash of the text), m, source_size, target, copies.

    A unit is the ``m`` rows of one identifier, source and text, counted before they are shuffled; ``copies`` is what
    they take together, the whole part of m times their share and one more by chance.  Groups that fly
    are formed by a hash of the unit and ordered by its columns, so the draw depends only on the rows and reruns agree.
    ``group`` bounds the units that meet in one task, whatever a source's share and whatever identifiers are null or repeated.
    """
    rows = word_sizes(docs, id_col, source_col, text_col)
    sizes = spill(rows.groupBy("id", "source", "size", "alike").agg(F.count(F.lit(1)).alias("m")), "sizes")
    goal = targets(sizes, weights, cap)
    ratio = F.when(F.col("source_size") > 0, F.least(F.lit(float(cap)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    joined = sizes.join(goal, sizes["source"].eqNullSafe(goal["source"])).drop(goal["source"])
    share = F.col("m") * ratio
    units = joined.withColumn("base", F.floor(share + F.lit(1e-9)).cast("long")).withColumn("chance", F.greatest(F.lit(0.0), share - F.col("base")))
    units = units.select(*_UNIT.names)

    def fly(last: bool):
        def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["id", "size", "alike"], kind="stable", na_position="first").reset_index(drop=True)
            seed = zlib.crc32(repr(key).encode())
            chance = flight(rows["chance"].to_numpy(float), rows["size"].to_numpy(float), np.random.default_rng(seed))
            wanted = float((rows["chance"] * rows["size"]).sum())
            rows["chance"] = land(chance, rows["size"].to_numpy(float), wanted, fixed=rows["chance"].to_numpy(float) <= 0) if last else chance
            return rows[_UNIT.names]

        return one

    decided = []
    most = units.agg(F.max("n")).first()[0] or 0
    while True:
        groups = F.greatest(F.lit(1), F.ceil(F.col("n") / group)).cast("int")
        cell = F.pmod(F.xxhash64("id", "size", "alike", F.lit(len(decided))), groups)
        last = most <= group
        flown = spill(units.withColumn("_cell", cell).groupBy("source", "_cell").applyInPandas(fly(last), _UNIT), "flown")
        if last:
            decided.append(flown)
            break
        open_ = (F.col("chance") > 1e-9) & (F.col("chance") < 1 - 1e-9)
        decided.append(flown.where(~open_))
        # at most 2 units stay open in each cell
        units = flown.where(open_).withColumn("n", F.ceil(F.col("n") / group) * 2)
        most = -(-most // group) * 2
    rows = decided[0]
    for more in decided[1:]:
        rows = rows.unionByName(more)
    copies = F.col("base") + F.round("chance").cast("long")
    return rows.select("id", "source", "size", "alike", "m", "source_size", "target", copies.alias("copies"))


def nth_copies(nth):
    """Copies of the ``nth`` (from 0) of a unit's rows alike: equal parts, the remainder to the first ones."""
    each = F.floor(F.col("copies") / F.col("m"))
    return each + F.when(nth < F.col("copies") - each * F.col("m"), F.lit(1)).otherwise(F.lit(0))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights=WEIGHTS, cap: float = CAP, group: int = 4096) -> DataFrame:
    """One row per document: id, source, size, source_size, target, copies, taken.

    A null or empty text has size 0 and takes nothing (its copies are still
    drawn).  Repeated rows share the copies of their unit, the first ones one more than the last.  Very long texts are
    counted whole; no document takes more than ``cap`` times its size, rounded up to whole copies.  An empty table gives an empty
    result; other columns are ignored, whatever their names.
    """
    units = draw(docs, id_col, source_col, text_col, weights, cap, group)
    pieces = units.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1, F.lit(STEP).cast("long"))))
    spread = pieces.where(F.col("m") <= STEP).unionByName(pieces.where(F.col("m") > STEP).repartition("id", "source", "alike", "_from"))
    rows = spread.withColumn("_nth", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + (STEP - 1), F.col("m") - 1))))
    rows = rows.withColumn("copies", nth_copies(F.col("_nth")).cast("long"))
    return rows.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
