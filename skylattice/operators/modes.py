"""Modes of a map at every density at once: the merge tree of its superlevel sets.

Cells enter in the order of falling density; a cell begins a mode, and every edge of a minimum spanning forest of
the touching cells (an edge weighs as the later of its cells) ends one.  So the modes within the first cells of the order are a running sum of
one minus the cell's own merges, for all targets and contours alike.

The forest is built by blocks of the sky.  Within a block, a merge of which one side touches no other block is final; of all others only
the edge between a cell at the border of each side is kept.  Blocks of blocks go on with these, so that what a task
holds grows with the border of its block, not with its cells.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import healpix
from ..functions import index as ix
from ..functions.types import fields
from ..storage import spill

_LIVE = ("kind:int", "uniq:long", "value:double", "other:long", "at:double", "cell:long", "n:long")
_CELL, _EDGE, _MERGE = range(3)


def settle(rows: pd.DataFrame, top: int, block: int, before: int | None) -> tuple[pd.DataFrame, pd.DataFrame, pd.DataFrame]:
    """(cells at the border, edges between them, merges that are final) of one block of order ``block``; -1 is the whole sky.

    ``rows`` are cells (uniq, value) and edges (uniq, other, at, cell) left by the blocks of order ``before`` within it; cells of the
    first round have none before.  An edge joins its two cells when the cell (at, cell) enters.
    """
    cells, edges = rows[rows["kind"] == _CELL], rows[rows["kind"] == _EDGE]
    uniq = cells["uniq"].to_numpy(np.int64)
    order = (np.frexp(uniq.astype(float))[1] - 1) // 2 - 1
    order = np.where(uniq < np.int64(4) ** (order + 1), order - 1, order)
    start = (uniq - np.int64(4) ** (order + 1)) << (2 * (top - order))
    by = np.argsort(start)
    uniq, order, start, value = uniq[by], order[by], start[by], cells["value"].to_numpy(float)[by]
    size = np.int64(1) << (2 * (top - order))
    near = healpix.neighbours(order, start >> (2 * (top - order)))
    there = near >= 0
    first = np.where(there, near, 0) << (2 * (top - order))[:, None]
    k = np.maximum(np.searchsorted(start, first, "right") - 1, 0)
    # a neighbour in finer cells is found from their side
    found = there & (start[k] <= first) & (first + size[:, None] <= start[k] + size[k])
    if before is not None:  # cells of one former block have met
        fine = (order >= before)[:, None]
        found &= ~fine | ((first >> (2 * (top - before))) != (start >> (2 * (top - before)))[:, None])
    out = there & ((first >> (2 * (top - block))) != (start >> (2 * (top - block)))[:, None]) if block >= 0 else np.zeros_like(there)
    a, place = np.nonzero(found)
    b = k[a, place]
    later = np.where((value[a] < value[b]) | ((value[a] == value[b]) & (uniq[a] > uniq[b])), a, b)
    number = np.argsort(uniq)
    at_of = lambda u: number[np.searchsorted(uniq[number], u)]
    a = np.concatenate((a, at_of(edges["uniq"].to_numpy(np.int64)) if len(edges) else np.zeros(0, np.int64)))
    b = np.concatenate((b, at_of(edges["other"].to_numpy(np.int64)) if len(edges) else np.zeros(0, np.int64)))
    at = np.concatenate((value[later], edges["at"].to_numpy(float)))
    cell = np.concatenate((uniq[later], edges["cell"].to_numpy(np.int64)))
    border = out.any(axis=1)
    root, mark = list(range(len(uniq))), np.where(border, np.arange(len(uniq)), -1).tolist()
    merged, left = [], []

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    turn = np.lexsort((cell, -at))
    for e, x, y in zip(turn.tolist(), a[turn].tolist(), b[turn].tolist()):
        x, y = find(x), find(y)
        if x == y:
            continue
        if mark[x] < 0 or mark[y] < 0:
            merged.append(e)
        else:
            left.append((e, mark[x], mark[y]))
        root[y] = x
        if mark[x] < 0:
            mark[x] = mark[y]
    ends, times = np.unique(cell[merged], return_counts=True)
    e = np.array([x[0] for x in left], int)
    joined = pd.DataFrame({"uniq": uniq[[x[1] for x in left]] if left else [], "other": uniq[[x[2] for x in left]] if left else [], "at": at[e], "cell": cell[e]})
    return pd.DataFrame({"uniq": uniq[border], "value": value[border]}), joined, pd.DataFrame({"cell": ends, "n": times})


def _round(keys: list[str], top: int, block: int, before: int | None):
    names = [f.split(":")[0] for f in _LIVE]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [p.assign(kind=kind) for kind, p in zip((_CELL, _EDGE, _MERGE), settle(rows, top, block, before))]
        out = pd.concat([p.reindex(columns=names) for p in parts if len(p)] or [parts[0].reindex(columns=names)], ignore_index=True)
        for c in ("uniq", "other", "cell", "n"):
            out[c] = out[c].astype("Int64")
        return pd.concat([pd.DataFrame({c: [rows[c].iloc[0]] * len(out) for c in keys}, index=out.index), out], axis=1)

    return run


def merges(df: DataFrame, keys: list[str] = [], density: str = "probdensity", leaf: int = 6, step: int = 3) -> DataFrame:
    """(keys, uniq, merged): how many modes end when each cell enters, densest first, ties by ``uniq``; cells without merges are left out.

    Cells touch at edges and corners, whatever their orders; maps may lack cells.  The first blocks have 4^leaf cells at most, each round
    takes 4^step blocks together.  A density that is null or NaN is the lowest.
    """
    value = F.coalesce(F.nanvl(F.col(density).cast("double"), F.lit(float("-inf"))), F.lit(float("-inf")))
    cells = spill(df.select(*keys, "uniq", value.alias("value"), ix.uniq2order("uniq").alias("_order")).where("_order >= 0"))
    top = cells.agg(F.max("_order")).first()[0]
    kinds = {k: {"bigint": "long"}.get(t, t) for k, t in df.dtypes}
    own = "".join(f"{k}:{kinds[k]}," for k in keys)
    none = lambda t: F.lit(None).cast(t)
    if top is None:
        return cells.select(*keys, "uniq", F.lit(0).cast("long").alias("merged"))
    live, done, before, above = None, [], None, top + 1
    rounds = [*range(max(top - leaf, 0), 0, -step), -1]
    for block in rounds:
        fresh = cells.where((F.col("_order") >= max(block, 0)) & (F.col("_order") < above))
        fresh = fresh.select(*keys, F.lit(_CELL).alias("kind"), "uniq", "value", none("long").alias("other"), none("double").alias("at"), none("long").alias("cell"), none("long").alias("n"))
        rows = fresh if live is None else live.unionByName(fresh)
        order, ipix = ix.uniq2nest("uniq")
        whose = ix.ancestor(ipix, order - block) if block >= 0 else F.lit(0).cast("long")
        rows = rows.withColumn("_block", whose)

        result = spill(rows.groupBy(*keys, "_block").applyInPandas(_round(keys, top, block, before), fields(own + ",".join(_LIVE))))
        done.append(result.where(F.col("kind") == _MERGE).select(*keys, F.col("cell").alias("uniq"), "n"))
        live, before, above = result.where(F.col("kind") != _MERGE), block, max(block, 0)
    ended = done[0]
    for more in done[1:]:
        ended = ended.unionByName(more)
    return ended.groupBy(*keys, "uniq").agg(F.sum("n").alias("merged"))


def with_steps(df: DataFrame, keys: list[str] = [], density: str = "probdensity", name: str = "modes_step") -> DataFrame:
    """Add what each cell adds to the number of modes when it enters: 1 for a new mode, 0 if it joins one, less if it joins several."""
    ended = merges(df, keys, density)
    return df.join(ended, [*keys, "uniq"], "left").withColumn(name, 1 - F.coalesce("merged", F.lit(0))).drop("merged")
