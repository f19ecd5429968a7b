"""Leaves of an adaptive tree with their samples, as a table function for SQL."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql.functions import arrow_udtf


def split(samples: np.ndarray, base: int, most: int, most_order: int):
    """Yield (order, ipix, first, last) of the leaves of base cell ``base``, depth first, as ranges of the sorted ``samples``.

    A cell is split while it holds ``most`` samples or more, down to ``most_order``.
    """
    todo = [(0, base, 0, len(samples))]
    while todo:
        order, ipix, first, last = todo.pop()
        if last - first < most or order >= most_order:
            yield order, ipix, first, last
            continue
        low = np.array([(4 * ipix + k) << (2 * (28 - order)) for k in range(1, 4)], np.int64)
        edges = [first, *(first + np.searchsorted(samples[first:last], low, "left")).tolist(), last]
        todo += [(order + 1, 4 * ipix + k, edges[k], edges[k + 1]) for k in (3, 2, 1, 0)]


@arrow_udtf(returnType="key string, nside long, ipix long, ipix0 long, ipix1 long, samples array<long>")
class TreeLeaves:
    """``SELECT * FROM sky_tree_leaves(TABLE(SELECT map_id, p29 >> 58 AS base, p29 FROM samples) PARTITION BY (map_id, base), 100, 29)``

    The first column names the map, the second the base cell, the third the samples (nested pixels at order 29).  A partition is a base cell of a map: 8 bytes a
    sample are held.  Leaves come depth first with the range of pixels that they span at order 29, empty ones beside full ones included.  Null samples are left out.
    """

    def __init__(self):
        self.held, self.key, self.most, self.order = [], None, 1, 29

    def eval(self, table: pa.RecordBatch, most: pa.Array, most_order: pa.Array):
        if table.num_rows:
            self.key, self.most, self.order = table.column(0)[0].as_py(), most[0].as_py(), most_order[0].as_py()
            self.held.append(table.column(2).drop_null().to_numpy().astype(np.int64))
        return iter(())

    def terminate(self):
        samples = np.sort(np.concatenate(self.held)) if self.held else np.zeros(0, np.int64)
        if not len(samples):
            return
        rows = list(split(samples, int(samples[0] >> 58), int(self.most), int(self.order)))
        order, ipix, first, last = (np.array(x, np.int64) for x in zip(*rows))
        wide = 2 * (29 - order)
        for k in range(0, len(rows), 1024):
            s = slice(k, k + 1024)
            lists = pa.ListArray.from_arrays(pa.array(np.append(first[s], last[s][-1]) - first[k], pa.int32()), pa.array(samples[first[k] : last[s][-1]]))
            name = pa.array([None if self.key is None else str(self.key)] * len(order[s]), pa.string())
            yield pa.table({"key": name, "nside": pa.array(1 << order[s]), "ipix": pa.array(ipix[s]), "ipix0": pa.array(ipix[s] << wide[s]), "ipix1": pa.array((ipix[s] + 1) << wide[s]), "samples": lists})
