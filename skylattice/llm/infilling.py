"""Fill-in-middle transformation by a parallel automaton scan.

One automaton over bytes finds the ends of tokens and the markers that a text must not contain.  Texts are cut
into chunks of equal size; a chunk gives, for every state in which it may be entered, the state in which it is left and
what it counts.  These functions compose associatively: their prefixes, found by doubling, give every chunk its entry
state and the counts before it, and the chunk that holds the wanted token gives the cut.

Texts up to ``giant`` bytes are scanned where they lie, without any shuffle.  The chunks of larger ones are dealt
over all tasks; only their functions (a few hundred bytes each) meet, and each cut is looked for in its own chunk alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_slices, schema, spill, text_of, utf8_column

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Classes of bytes.  Bytes of characters beyond ASCII are words like all others.
OTHER, SPACE, LESS, LETTER, GREATER = range(5)
#: States: nothing read, in white space, in a word, in a word behind ``<``, in a word behind ``<P``, ``<S`` or ``<M``.
START, BLANK, WORD, OPENED, NAMED = range(5)
STATES = 5
CLASS = np.zeros(256, np.uint8)
CLASS[[32, *range(9, 14)]] = SPACE
CLASS[ord("<")], CLASS[ord(">")] = LESS, GREATER
CLASS[[ord(c) for c in "PSM"]] = LETTER
NEXT = np.full((STATES, 5), WORD, np.uint8)  # state, class
NEXT[:, SPACE], NEXT[:, LESS], NEXT[OPENED, LETTER] = BLANK, OPENED, NAMED
#: What a byte counts in a state: the end of the token before it, and a marker.
COUNTS = np.zeros((2, STATES, 5), np.uint8)
COUNTS[0, WORD:, SPACE] = 1
COUNTS[1, NAMED, GREATER] = 1
#: Two bytes lead every state to the same one, so behind them a chunk's run doesn't depend on its entry.
PAIR = NEXT[NEXT[START]].reshape(-1)
assert (NEXT[NEXT] == NEXT[NEXT[START]]).all()


def _inner(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(classes, counts of every byte but the first two of each chunk, states after every byte but the first of each)."""
    c = CLASS[data]
    state = np.zeros(len(c), np.uint8)
    state[1:] = PAIR[c[:-1] * np.uint8(5) + c[1:]]
    flags = []
    for table in COUNTS:
        f = np.zeros(len(c), np.uint8)
        f[1:] = table.reshape(-1)[state[:-1] * np.uint8(5) + c[1:]]
        f[at[:-1]] = 0
        f[at[:-1][np.diff(at) > 1] + 1] = 0
        flags.append(f)
    return c, flags, state


def functions(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(state at the end, counts) of every chunk ``at[k]:at[k + 1]`` for every entry state, and the flags of ``_inner``.

    Chunks aren't empty.  Shapes are (chunks, states) and (chunks, states, 2).
    """
    m = len(at) - 1
    if not m:
        return np.zeros((0, STATES), np.uint8), np.zeros((0, STATES, 2), np.int64), [np.zeros(0, np.uint8)] * 2
    c, flags, state = _inner(data, at)
    first, size = at[:-1], np.diff(at)
    step = NEXT[:, c[first]].T.copy()
    counts = np.stack([table[:, c[first]].T for table in COUNTS], axis=2).astype(np.int64)
    long = np.flatnonzero(size > 1)
    then = c[first[long] + 1]
    for k, table in enumerate(COUNTS):
        counts[long, :, k] += table[step[long], then[:, None]]
    step[long] = state[at[1:][long] - 1][:, None]
    for k, f in enumerate(flags):
        counts[:, :, k] += np.add.reduceat(f, first, dtype=np.int64)[:, None]
    return step, counts, flags


def compose(step: np.ndarray, counts: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every chunk's function composed with those of the ``reach`` chunks before it, by doubling."""
    step, counts, d = step.copy(), counts.copy(), 1
    while len(reach) and d <= reach.max():
        at = np.flatnonzero(reach >= d)
        row, middle = np.arange(len(at))[:, None], step[at - d]
        total = counts[at - d] + counts[at][row, middle]
        step[at] = step[at][row, middle]
        counts[at] = total
        d *= 2
    return step, counts


def entries(step: np.ndarray, counts: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(state in which every chunk is entered, counts before it) when the first of its text is entered at START."""
    step, counts = compose(step, counts, reach)
    state, before = np.full(len(step), START, np.uint8), np.zeros((len(step), 2), np.int64)
    later = np.flatnonzero(reach > 0)
    state[later], before[later] = step[later - 1, START], counts[later - 1, START]
    return state, before


def token_ends(data: np.ndarray, at: np.ndarray, flags: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Places of the bytes before which a token ends, in chunks entered in the given states."""
    flags, first = flags.copy(), at[:-1]
    c = CLASS[data[first]]
    flags[first] = COUNTS[0][state, c]
    long = np.flatnonzero(np.diff(at) > 1)
    flags[first[long] + 1] = COUNTS[0][NEXT[state[long], c[long]], CLASS[data[first[long] + 1]]]
    return np.flatnonzero(flags)


def _units(h1: np.ndarray, h2: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = h1 % (n + 1), h2 % (n + 1)
    return np.minimum(a, b), np.maximum(a, b)


def _characters(data: np.ndarray) -> np.ndarray:
    """Number of characters that begin before every byte, and before the end."""
    return np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))


def scan(data: np.ndarray, offsets: np.ndarray, h1: np.ndarray, h2: np.ndarray, chunk: int) -> tuple[np.ndarray, ...]:
    """(tokens, characters to the first cut, to the second, whether a marker occurs) of texts that lie one behind the other."""
    size = np.diff(offsets)
    pieces = -(-size // chunk)
    doc = np.repeat(np.arange(len(size)), pieces)
    reach = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at = np.append(offsets[:-1][doc] + reach * chunk, offsets[-1])
    step, counts, flags = functions(data, at)
    state, before = entries(step, counts, reach)
    ends = token_ends(data, at, flags[0], state) if len(doc) else np.zeros(0, np.int64)
    first, last = np.searchsorted(ends, offsets[:-1]), np.searchsorted(ends, offsets[1:])
    n = last - first + (size > 0)
    upto, marked = _characters(data), np.zeros(len(size), bool)
    if len(doc):
        own = counts[np.arange(len(doc)), state, 1] > 0
        marked[doc[own]] = True
    cuts = []
    for units in _units(h1, h2, n):
        place = np.where(units == n, offsets[1:], offsets[:-1])
        inside = np.flatnonzero((units > 0) & (units < n))
        place[inside] = ends[first[inside] + units[inside] - 1]
        cuts.append(upto[place] - upto[offsets[:-1]])
    return n, cuts[0], cuts[1], marked


def _draws(key: str, seed: str, count: int) -> list[Column]:
    """The first 8-digit groups of the hash of the seed and the key, as numbers."""
    held = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(held, 8 * k + 1, 8), 16, 10).cast("long") for k in range(count)]


def _scan_small(plain: DataFrame, found: list[str], chunk: int) -> DataFrame:
    out = T.StructType([*plain.schema, *schema(*[(c, "long") for c in found[:3]], (found[3], "boolean"))])

    def run(batches):
        for batch in in_slices(batches, column="_text"):
            data, offsets = utf8_column(batch.column("_text"))
            h1, h2 = (batch.column(c).to_numpy() for c in ("_h1", "_h2"))
            got = scan(data, offsets, h1, h2, chunk)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(x) for x in got]], out.names)

    return plain.mapInArrow(run, out)


def _scan_giant(plain: DataFrame, found: list[str], chunk: int) -> DataFrame:
    """The same with the chunks of each text dealt over all tasks.  ``plain`` is written once, so that its numbers stay."""
    held = spill(plain.withColumn("_row", F.monotonically_increasing_id()), "giant")
    cut = schema(("_row", "long"), ("_h1", "long"), ("_h2", "long"), ("_k", "long"), ("text", "binary"))

    def chunks(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                data, _ = utf8_column(batch.column(3).slice(i, 1))
                most = max(1, (8 << 20) // chunk)  # chunks of a record batch
                for k in range(0, -(-len(data) // chunk), most):
                    some = [data[j : j + chunk].tobytes() for j in range(k * chunk, min(len(data), (k + most) * chunk), chunk)]
                    same = [pa.array([batch.column(c)[i].as_py()] * len(some), pa.int64()) for c in range(3)]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(range(k, k + len(some)), pa.int64()), pa.array(some, pa.binary())], cut.names)

    dealt = spill(held.select("_row", "_h1", "_h2", F.col("_text").alias("text")).mapInArrow(chunks, cut).repartition("_row", "_k"), "chunks")
    told = schema(("_row", "long"), ("_h1", "long"), ("_h2", "long"), ("_k", "long"), ("step", "array<int>"), ("ends", "array<long>"), ("marks", "array<long>"), ("chars", "long"))

    def functions_of(batches):
        for batch in in_slices(batches):
            data, at = utf8_column(batch.column("text"))
            step, counts, _ = functions(data, at)
            upto = _characters(data)
            lists = [pa.array(x.tolist()) for x in (step, counts[:, :, 0], counts[:, :, 1])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(lists[0], pa.list_(pa.int32())), *lists[1:], pa.array(upto[at[1:]] - upto[at[:-1]])], told.names)

    wanted = schema(("_row", "long"), ("_k", "long"), ("which", "int"), ("state", "int"), ("nth", "long"), ("chars", "long"), ("n", "long"), ("marked", "boolean"))

    def select(rows: pd.DataFrame) -> pd.DataFrame:
        # a text has 2 GB at most, so these are its few thousand functions
        rows = rows.sort_values("_k")
        step = np.array(rows["step"].tolist(), np.uint8)
        counts = np.stack([np.array(rows[c].tolist(), np.int64) for c in ("ends", "marks")], axis=2)
        reach = np.arange(len(rows))
        state, before = entries(step, counts, reach)
        own = counts[reach, state]
        n = int(before[-1, 0] + own[-1, 0]) + 1
        chars = np.concatenate(([0], np.cumsum(rows["chars"].to_numpy())))
        out = []
        for which, units in enumerate(_units(*(rows[c].to_numpy()[:1] for c in ("_h1", "_h2")), np.array([n]))):
            units = int(units[0])
            if units in (0, n):
                out.append((rows["_row"].iloc[0], -1, which, 0, 0, int(chars[-1]) if units else 0))
            else:
                k = int(np.searchsorted(before[:, 0], units, "left")) - 1
                out.append((rows["_row"].iloc[0], k, which, int(state[k]), units - int(before[k, 0]), int(chars[k])))
        marked = bool(own[:, 1].sum() > 0)
        return pd.DataFrame([(*x, n, marked) for x in out], columns=wanted.names)

    picked = spill(dealt.mapInArrow(functions_of, told).groupBy("_row").applyInPandas(select, wanted), "cuts")
    inside = picked.where("_k >= 0").join(dealt.select("_row", "_k", "text"), ["_row", "_k"]).select(*[c for c in wanted.names], "text")
    placed = schema(*[(f.name, f.dataType.simpleString().replace("bigint", "long")) for f in wanted])

    def places(batches):
        for batch in in_slices(batches):
            data, at = utf8_column(batch.column("text"))
            _, _, flags = functions(data, at)
            ends = token_ends(data, at, flags[0], batch.column("state").to_numpy().astype(np.uint8))
            place = ends[np.searchsorted(ends, at[:-1]) + batch.column("nth").to_numpy() - 1]
            upto = _characters(data)
            columns = {c: batch.column(c) for c in placed.names} | {"chars": pa.array(batch.column("chars").to_numpy() + upto[place] - upto[at[:-1]])}
            yield pa.RecordBatch.from_arrays([columns[c] for c in placed.names], placed.names)

    ends = picked.where("_k < 0").unionByName(inside.mapInArrow(places, placed))
    cuts = ends.groupBy("_row").agg(F.first("n").alias(found[0]), F.max(F.when(F.col("which") == 0, F.col("chars"))).alias(found[1]), F.max(F.when(F.col("which") == 1, F.col("chars"))).alias(found[2]), F.first("marked").alias(found[3]))
    return held.join(cuts, "_row").drop("_row")


def transform(docs: DataFrame, key: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), seed: str = "42", rate: int = 50, spm_rate: int = 80, chunk: int = 1 << 14, giant: int = 1 << 16) -> DataFrame:
    """(key, kept columns, text, n, form, prefix_chars, middle_chars, output): every text with its middle moved to the end.

    A text is n tokens, each a word with the white space before it, or white space at the end.  Two of the n + 1 places between
    tokens, drawn by the hash of seed and key, cut it in prefix, middle and suffix.  ``rate`` percent of the texts are
    transformed, ``spm_rate`` percent of these with the suffix first (spm), the others with the prefix first (psm); all others, empty
    texts and texts that contain a marker stay as they are (plain), without cuts.

    A null text is empty, a null key hashes like an empty one.  Repeated rows give repeated results, an empty
    table gives none.  Columns that aren't kept are ignored; one with the name of a result can't be kept.
    Texts above ``giant`` bytes are scanned by many tasks, ``chunk`` bytes at a time; the results don't depend on either.
    """
    results = ("text", "n", "form", "prefix_chars", "middle_chars", "output")
    if set(results) & {key, *keep}:
        raise ValueError(f"{', '.join(results)} are the result's; rename the table's own to keep them")
    draws = _draws(key, seed, 4)
    plain = docs.select(key, *keep, *[d.alias(f"_h{k + 1}") for k, d in enumerate(draws)], text_of(text_col).alias("_text"))
    found = ["n", "_first", "_second", "_marked"]
    large = F.octet_length("_text") > giant
    out = _scan_small(plain.where(~large), found, chunk)
    out = out.unionByName(_scan_giant(plain.where(large), found, chunk))
    stays = F.col("_marked") | (F.col("n") == 0) | (F.col("_h3") % 100 >= rate)
    form = F.when(stays, "plain").when(F.col("_h4") % 100 < spm_rate, "spm").otherwise("psm")
    out = out.withColumn("form", form).withColumn("prefix_chars", F.when(~stays, F.col("_first"))).withColumn("middle_chars", F.when(~stays, F.col("_second") - F.col("_first")))
    text, first, second = F.col("_text"), F.col("_first").cast("int"), F.col("_second").cast("int")
    prefix, middle = text.substr(F.lit(1), first), text.substr(first + 1, second - first)
    suffix = text.substr(second + 1, F.lit(2**31 - 1))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    output = F.when(stays, text).when(F.col("form") == "psm", psm).otherwise(spm)
    return out.select(key, *keep, text.alias("text"), "n", "form", "prefix_chars", "middle_chars", output.alias("output"))


def restored(form: str = "form", output: str = "output") -> Column:
    """The text that an output was made of, from the output and its form alone."""
    whole = F.col(output)

    def parts(head: str, next_: str):
        body = whole.substr(F.lit(len(head) + 1), F.lit(2**31 - 1))
        one = F.substring_index(body, next_, 1)
        rest = body.substr(F.length(one) + len(next_) + 1, F.lit(2**31 - 1))
        two = F.substring_index(rest, MIDDLE, 1)
        return one, two, rest.substr(F.length(two) + len(MIDDLE) + 1, F.lit(2**31 - 1))

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    suffix2, prefix2, middle2 = parts(SUFFIX, PREFIX)
    return F.when(F.col(form) == "plain", whole).when(F.col(form) == "psm", F.concat(prefix, middle, suffix)).otherwise(F.concat(prefix2, middle2, suffix2))


def digest(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256)"""
    return rows.select(key, "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))
