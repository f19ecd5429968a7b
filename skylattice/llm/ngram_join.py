"""N-gram Jaccard join: a size-aware heavy-light join of shingle sets.

Documents with the same set are one set; joins run over distinct sets.  A global order of
shingles (rare ones first, by a count sketch over all documents) gives the prefix of a
set: sets that link share a shingle among the first n - ceil(0.8 n) + 1, and k shingles
among the first n - ceil(0.8 n) + k.

* light: a set of at most ``boundary`` shingles enumerates the subsets of fixed size 2 of
  its 2-prefix; two such sets that link share one of them.
* heavy: a larger set (and a light one that a heavy one can link with) is found by scanning the
  inverted lists of the shingles of its 1-prefix.

The boundary is the size at which the cost of all subsets and all list entries, from the
table's own distribution of sizes, is least.

Lists are joined without their pairs.  First each set is compared with the leader of
its list, the smallest set that its size can link with; verified links are joined to components.  Then only lists that still
hold several components are completed: their sets are compared in blocks with a 512-bit
parity bitmap, a lower bound of the sets' difference, and pairs of different components that pass are
verified.  Verification intersects whole sets.  Nothing is capped, so no link between components is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices, is_space, schema, spill, utf8_column
from .graph import components

WORDS = 5
NUMERATOR, DENOMINATOR = 4, 5  # similarity of 0.8
SKETCH_BITS = 17
BITMAP = 512
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct shingles of each document of a UTF-8 column, sorted by both.

    Fewer than ``words`` words are one shingle; a text without words has none.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if not len(data):
        return none
    space = is_space(data)
    first = ~space
    first[1:] &= space[:-1]
    starts = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[starts] = ~space[starts]
    at = np.flatnonzero(first)
    if not len(at):
        return none
    # polynomial hash of each word, then mixed
    span = np.diff(np.append(at, len(data)))
    place = np.arange(at[0], len(data)) - np.repeat(at, span)
    power = np.full(int(place.max()) + 1, _ODD, np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    value = np.where(space[at[0] :], np.uint64(0), (_LOWER[data[at[0] :]].astype(np.uint64) + np.uint64(1)) * power[place])
    word = mix(np.add.reduceat(value, at - at[0]))
    doc = np.searchsorted(offsets, at, "right") - 1
    count = np.bincount(doc, minlength=len(offsets) - 1)
    # runs of ``words`` words; where a document has fewer, one run of all
    begin = np.concatenate([[0], np.cumsum(count)])[:-1]
    length = np.minimum(count, words)[doc]
    full = (np.arange(len(at)) - begin[doc]) <= (count[doc] - length)
    code = np.zeros(len(at), np.uint64)
    for k in range(words):
        part = np.roll(word, -k)
        code = np.where(k < length, (code + part) * _ODD + np.uint64(k + 1), code)
    doc, code = doc[full], mix(code[full])
    order = np.lexsort((code, doc))
    doc, code = doc[order], code[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])
    return doc[fresh], code[fresh]


def least_overlap(n):
    return -(-(n * NUMERATOR) // DENOMINATOR)


def prefix(n, k: int = 1):
    """Length of the k-prefix of a set of n shingles."""
    return np.minimum(n, n - least_overlap(n) + k)


def boundary(histogram: dict[int, int], list_cost: float = 4.0, most: int = 64) -> int:
    """Largest light size: least total of subsets of light sets and list entries of the others.

    A list entry counts ``list_cost`` subsets: it meets sets that share but one shingle.
    """

    def cost(x: int) -> float:
        light = sum(c * prefix(n, 2) * (prefix(n, 2) - 1) / 2 for n, c in histogram.items() if 2 <= n <= x)
        heavy = sum(c * prefix(n) * list_cost for n, c in histogram.items() if n >= least_overlap(x + 1))
        return float(light + heavy)

    return min(range(1, most + 1), key=lambda x: (cost(x), x))


def _sid(doc: np.ndarray, code: np.ndarray, n: int) -> np.ndarray:
    """Identifier of each document's set, whatever the order; 0 for an empty set."""
    out = np.zeros(n, np.uint64)
    np.add.at(out, doc, mix(code + np.uint64(0x5851F42D4C957F2D)))
    size = np.bincount(doc, minlength=n).astype(np.uint64)
    return np.where(size > 0, mix(out + size * _ODD), np.uint64(0)).view(np.int64)


def _bucket(code: np.ndarray) -> np.ndarray:
    return (code >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def survey(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(documents: id, sid, n, bitmap; documents of each hash bucket of shingles), in one pass over all documents."""
    out = schema(("id", "long"), ("sid", "long"), ("n", "int"), ("bitmap", "binary"), ("bucket", "int"), ("seen", "long"))

    def run(batches):
        held = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in in_slices(batches):
            rows = batch.num_rows
            doc, code = shingles(*utf8_column(batch.column(1)))
            held += np.bincount(_bucket(code), minlength=len(held))
            # parity of the shingles in each of 512 classes
            bit = np.bincount(doc * BITMAP + (code & np.uint64(BITMAP - 1)).astype(np.int64), minlength=rows * BITMAP) & 1
            bitmap = np.packbits(bit.reshape(rows, BITMAP).astype(np.uint8), axis=1)
            size = np.bincount(doc, minlength=rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_sid(doc, code, rows)), pa.array(size, pa.int32()), pa.array([b.tobytes() for b in bitmap], pa.binary()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.int64())], out.names)
        some = np.flatnonzero(held)
        m = len(some)
        yield pa.RecordBatch.from_arrays([pa.nulls(m, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.binary())] + [pa.array(some, pa.int32()), pa.array(held[some])], out.names)

    both = spill(docs.select("id", "text").mapInArrow(run, out), "survey")
    found = both.where("bucket is not null").groupBy("bucket").agg(F.sum("seen").alias("n")).toArrow()
    order = np.zeros(1 << SKETCH_BITS, np.uint32)
    order[found.column("bucket").to_numpy()] = np.minimum(found.column("n").to_numpy(), 2**32 - 1)
    return both.where("bucket is null").select("id", "sid", "n", "bitmap"), order


def signatures(docs: DataFrame, order: np.ndarray, light: int) -> DataFrame:
    """(key, sid, n): the list entries and subsets of each document's set."""
    out = schema(("key", "long"), ("sid", "long"), ("n", "int"))
    floor = int(least_overlap(light + 1))  # a set of this size can link with a heavy one

    def run(batches):
        for batch in in_slices(batches):
            rows = batch.num_rows
            doc, code = shingles(*utf8_column(batch.column(0)))
            sid = _sid(doc, code, rows)
            size = np.bincount(doc, minlength=rows)
            if not len(doc):
                continue
            ranked = np.lexsort((code, order[_bucket(code)], doc))
            doc, code = doc[ranked], code[ranked]
            begin = np.concatenate([[0], np.cumsum(size)])[:-1]
            place = np.arange(len(doc)) - begin[doc]
            heavy = (size[doc] >= floor) & (size[doc] > 1) & (place < prefix(size)[doc])
            keys, owner = [code[heavy]], [doc[heavy]]
            small = np.flatnonzero((size >= 2) & (size <= light))
            two = prefix(size, 2)
            for m in np.unique(two[small]):  # documents with prefixes of one length at a time
                some = small[two[small] == m]
                head = code[begin[some][:, None] + np.arange(m)]
                a, b = np.triu_indices(m, 1)
                keys.append(mix(np.minimum(head[:, a], head[:, b]) * _ODD + np.maximum(head[:, a], head[:, b])).ravel())
                owner.append(np.repeat(some, len(a)))
            keys, owner = np.concatenate(keys).view(np.int64), np.concatenate(owner)
            # copies of a set in this slice give one entry
            pair = np.lexsort((sid[owner], keys))
            keys, own = keys[pair], sid[owner][pair]
            fresh = np.ones(len(keys), bool)
            fresh[1:] = (keys[1:] != keys[:-1]) | (own[1:] != own[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(keys[fresh]), pa.array(own[fresh]), pa.array(size[owner][pair][fresh], pa.int32())], out.names)

    return docs.select("text").mapInArrow(run, out)


def _size_fits(small, large):
    return small * DENOMINATOR >= large * NUMERATOR


_LISTED = schema(("key", "long"), ("a", "long"), ("b", "long"), ("n", "int"), ("m", "int"))


def lead(entries: DataFrame) -> DataFrame:
    """Pairs (key null, leader a of size n, b of size m) of each list, and the entries (key, a, -, n) of lists of two and more.

    ``entries`` are dealt by key and sorted by key, n and sid.  Lists go by as a stream: of a list
    longer than a batch only the leader is held.
    """

    def pairs_of(key, sid, n, state):
        """(leader of each row, its size, state after)"""
        fresh = np.ones(len(key), bool)
        fresh[1:] = key[1:] != key[:-1]
        group = np.cumsum(fresh) - 1
        head = np.flatnonzero(fresh)
        leader_sid, leader_n = sid[head][group], n[head][group]
        if state is not None and state[0] == key[0]:
            mine = group == 0
            leader_sid = np.where(mine, state[1], leader_sid)
            leader_n = np.where(mine, state[2], leader_n)
        while True:
            off = ~_size_fits(leader_n, n)
            if not off.any():
                break
            # the first row of a list that is too large for its leader leads from there on
            idx = np.flatnonzero(off)
            g, first = np.unique(group[idx], return_index=True)
            new = np.full(group[-1] + 1, -1)
            new[g] = idx[first]
            take = off
            leader_sid = np.where(take, sid[np.maximum(0, new[group])], leader_sid)
            leader_n = np.where(take, n[np.maximum(0, new[group])], leader_n)
        return leader_sid, leader_n, (key[-1], leader_sid[-1], leader_n[-1])

    def run(batches):
        held, state = None, None

        def emit(key, sid, n):
            nonlocal state
            same = np.zeros(len(key), bool)  # copies of a set from several slices
            same[1:] = (key[1:] == key[:-1]) & (sid[1:] == sid[:-1])
            key, sid, n = key[~same], sid[~same], n[~same]
            goes_on = state is not None and state[0] == key[0]
            leader, leader_n, state = pairs_of(key, sid, n, state)
            _, of, count = np.unique(key, return_inverse=True, return_counts=True)
            if goes_on:
                count[of[0]] += 2
            real = leader != sid
            m = int(real.sum())
            if m:
                yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.array(leader[real]), pa.array(sid[real]), pa.array(leader_n[real], pa.int32()), pa.array(n[real], pa.int32())], _LISTED.names)
            many = count[of] >= 2
            m = int(many.sum())
            if m:
                yield pa.RecordBatch.from_arrays([pa.array(key[many]), pa.array(sid[many]), pa.nulls(m, pa.int64()), pa.array(n[many], pa.int32()), pa.nulls(m, pa.int32())], _LISTED.names)

        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            if len(held[0]) < 500_000:
                continue
            # rows of the last key wait for the rest of its list, unless they fill the batch
            cut = int(np.searchsorted(held[0], held[0][-1]))
            cut = cut if cut > len(held[0]) // 2 else len(held[0])
            yield from emit(*(x[:cut] for x in held))
            held = [x[cut:] for x in held] if cut < len(held[0]) else None
        if held is not None and len(held[0]):
            yield from emit(*held)

    return entries.select("key", "sid", "n").mapInArrow(run, _LISTED)


def linked(docs: DataFrame, pairs: DataFrame, sets: DataFrame, sift_first: bool, per_leader: int = 512, most_broadcast: int = 16 << 20) -> DataFrame:
    """The pairs (a, b) of set identifiers that link, by intersecting whole sets.

    ``sets`` has (sid, id, n, bitmap) with one document for each set.  The identifiers of the
    documents to be read again are broadcast if they take ``most_broadcast`` bytes at most,
    else texts are joined by a shuffle; both give the same pairs.
    """
    def sift(batches):
        for batch in batches:
            if batch.num_rows:
                na, nb = (batch.column(k).to_numpy().astype(np.int64) for k in (2, 3))
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (4, 5))
                differ = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
                yield batch.select([0, 1]).filter(pa.array(may_link(na, nb, differ)))

    near = pairs.select("a", "b")
    if sift_first:
        near = pairs.join(sets.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("bitmap").alias("ba")), "a")
        near = near.join(sets.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("bitmap").alias("bb")), "b")
        near = near.select("a", "b", "na", "nb", "ba", "bb").mapInArrow(sift, schema(("a", "long"), ("b", "long")))
    near = spill(near, "near")

    # every set goes to the leaders that it must meet; a leader of many is dealt to several tasks
    salts = near.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / per_leader).alias("_m"))
    dealt = near.join(salts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("_m")).alias("salt"))
    member = dealt.select(F.col("b").alias("sid"), F.struct(F.col("a").alias("leader"), "salt", F.lit(1).alias("member")).alias("role"))
    leader = dealt.select(F.col("a").alias("sid"), F.struct(F.col("a").alias("leader"), "salt", F.lit(0).alias("member")).alias("role")).distinct()
    # a leader of very many is several rows, of 256 roles each
    part = F.when(F.col("role.member") == 0, F.floor(F.col("role.salt") / 256)).otherwise(F.lit(0))
    needed = member.unionByName(leader).groupBy("sid", part.alias("_part")).agg(F.collect_list("role").alias("roles")).drop("_part").join(sets.select("sid", F.col("id").alias("_id")), "sid")
    needed = spill(needed, "needed")
    held = needed.agg(F.sum(F.size("roles") * 40 + 64)).first()[0]  # bytes: a role is a row of three numbers, and its place
    if held is None:
        return near
    if held <= most_broadcast:
        needed = F.broadcast(needed)
    texts = docs.join(needed, F.col("id").eqNullSafe(F.col("_id"))).select("sid", "text", "roles")
    row = schema(("leader", "long"), ("salt", "long"), ("member", "int"), ("sid", "long"), ("codes", "binary"))

    def expand(batches):
        for batch in in_slices(batches, 1 << 20, column="text"):
            rows = batch.num_rows
            doc, code = shingles(*utf8_column(batch.column(1)))
            edge = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=rows))])
            right = _sid(doc, code, rows) == batch.column(0).to_numpy()  # else another text of the same identifier
            for k, roles in enumerate(batch.column(2).to_pylist()):
                if right[k]:
                    whole = code[edge[k] : edge[k + 1]].tobytes()
                    step = max(1, min(64, (4 << 20) // (len(whole) + 1)))  # copies of a set that are held at once
                    for i in range(0, len(roles), step):
                        some = roles[i : i + step]
                        n = len(some)
                        yield pa.RecordBatch.from_arrays([pa.array([r["leader"] for r in some], pa.int64()), pa.array([r["salt"] for r in some], pa.int64()), pa.array([r["member"] for r in some], pa.int32()), pa.array([batch.column(0)[k].as_py()] * n, pa.int64()), pa.array([whole] * n, pa.binary())], row.names)

    def check(batches):
        own = codes = None
        for batch in batches:
            found = []
            for leader, salt, member, sid, raw in zip(*(c.to_pylist() for c in batch.columns)):
                x = np.frombuffer(raw, np.uint64)
                if not member:
                    own, codes = (leader, salt), x
                elif own == (leader, salt):
                    common = len(np.intersect1d(x, codes, assume_unique=True))
                    if common * DENOMINATOR >= NUMERATOR * (len(x) + len(codes) - common):
                        found.append((leader, sid))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])

    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = texts.mapInArrow(expand, row).repartition(tasks, "leader", "salt").sortWithinPartitions("leader", "salt", "member")
    return met.mapInArrow(check, schema(("a", "long"), ("b", "long"))).distinct()


def may_link(na, nb, differ):
    """Whether sets of these sizes with at least ``differ`` unshared shingles can link: differ <= (na + nb) / 9."""
    total = na + nb
    return (differ * (NUMERATOR + DENOMINATOR) <= total * (DENOMINATOR - NUMERATOR)) & _size_fits(np.minimum(na, nb), np.maximum(na, nb))


def least_shared(na, nb, light: int):
    """Column: how many keys two sets of sizes na, nb must share at least to link.

    Of two prefixes, let that of x end first in the global order.  What x and y share is in both prefixes
    or among the ceil(0.8 |x|) - 1 shingles of x behind its own; to link they share 4/9 (|x| + |y|) or more.  The
    weaker bound is that of the larger set.  Two light sets share subsets instead, one at least.
    """
    small, large = F.least(na, nb), F.greatest(na, nb)
    whole = DENOMINATOR + NUMERATOR
    overlap = F.ceil((small + large) * NUMERATOR / whole)
    bound = overlap - F.ceil(large * NUMERATOR / DENOMINATOR) + 1
    return F.when(large > light, F.greatest(F.lit(1), bound)).otherwise(F.lit(1))


def unfinished(lists: DataFrame, roots: DataFrame, sets: DataFrame, light: int, best: int | None, block: int = 2048, small: int = 64) -> DataFrame:
    """Pairs (a, b) of different components that share lists and may link: of each set the ``best`` ones, or all (None).

    Lists of one component are done.  The others are compared block by block: a list of m blocks is
    dealt to m (m + 1) / 2 groups of at most about two blocks, so no group grows with a list.
    Pairs that share too few lists are left out.  Only with None is the number of shared lists exact; with a limit it counts the lists
    that name a pair, so links may be missed and an empty result proves nothing: a round with None must follow.
    """
    labelled = lists.join(roots.select(F.col("node").alias("a"), "root"), "a", "left").withColumn("root", F.coalesce("root", "a"))
    open_ = labelled.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.ceil(F.count(F.lit(1)) / block).cast("int").alias("m")).where("x <> y").select("key", "m")
    rows = labelled.join(open_, "key").join(sets.select(F.col("sid").alias("a"), "bitmap"), "a")
    own = F.pmod(F.xxhash64("a"), F.col("m")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "a", "n", "root", "bitmap")
    dealt = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "own")
    out = schema(("a", "long"), ("b", "long"), ("na", "int"), ("nb", "int"), ("differ", "int"))

    def compare(cell):
        own, a, n, root, bits = cell
        found = []
        i = own == own[0]
        j = i if i.all() else ~i
        first, second = np.flatnonzero(i), np.flatnonzero(j)
        for k in first:
            # with a limit every set has a choice of its own; without, a pair is named once
            other = second if j is not i else second[second != k] if best is not None else second[second > k]
            if not len(other):
                continue
            other = other[(root[other] != root[k]) & _size_fits(np.minimum(n[other], n[k]), np.maximum(n[other], n[k]))]
            if not len(other):
                continue
            differ = np.bitwise_count(bits[other] ^ bits[k]).sum(axis=1, dtype=np.int64)
            fits = may_link(n[other], n[k], differ)
            other, differ = other[fits], differ[fits]
            if best is not None and len(other) > best:
                top = np.lexsort((a[other], differ))[:best]
                other, differ = other[top], differ[top]
            if len(other):
                # from the smaller identifier to the larger, so that all lists name a pair alike
                swap = a[other] < a[k]
                found.append(np.stack([np.where(swap, a[other], a[k]), np.where(swap, a[k], a[other]), np.where(swap, n[other], n[k]), np.where(swap, n[k], n[other]), differ]))
        return np.concatenate(found, axis=1) if found else np.zeros((5, 0), np.int64)

    def run(batches):
        waiting = None

        def cells(columns):
            place, own, a, n, root, bits = columns
            fresh = np.ones(len(a), bool)
            fresh[1:] = np.any(place[1:] != place[:-1], axis=1)
            start = np.flatnonzero(fresh)
            size = np.diff(np.append(start, len(a)))
            mixed = np.minimum.reduceat(root, start) != np.maximum.reduceat(root, start)
            whole = np.minimum.reduceat(own, start) == np.maximum.reduceat(own, start)
            short = mixed & whole & (size <= small)
            # the pairs of all short cells at once: each row with those after it in its cell
            rows = np.flatnonzero(np.repeat(short, size))
            after = np.repeat(start + size, size)[rows] - rows - 1
            for part in np.array_split(np.arange(len(rows)), max(1, int(after.sum()) // 200_000)):
                left = np.repeat(rows[part], after[part])
                right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(after[part]) - after[part], after[part])
                fits = (root[left] != root[right]) & _size_fits(np.minimum(n[left], n[right]), np.maximum(n[left], n[right]))
                left, right = left[fits], right[fits]
                differ = np.bitwise_count(bits[left] ^ bits[right]).sum(axis=1, dtype=np.int64)
                fits = may_link(n[left], n[right], differ)
                left, right, differ = left[fits], right[fits], differ[fits]
                swap = a[right] < a[left]
                left, right = np.where(swap, right, left), np.where(swap, left, right)
                yield np.stack([a[left], a[right], n[left], n[right], differ])
            for k in np.flatnonzero(mixed & ~short):
                rows = slice(start[k], start[k] + size[k])
                yield compare([c[rows] for c in columns[1:]])

        def emit(columns):
            for x in cells(columns):
                if x.shape[1]:
                    yield pa.RecordBatch.from_arrays([pa.array(x[0]), pa.array(x[1]), *(pa.array(x[k], pa.int32()) for k in (2, 3, 4))], out.names)

        def together(found):
            part, n = [], 0
            for x in found:
                part.append(x)
                n += x.num_rows
                if n > 50_000:
                    yield from pa.Table.from_batches(part).combine_chunks().to_batches()
                    part, n = [], 0
            if part:
                yield from pa.Table.from_batches(part).combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            now = [np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1), *(batch.column(k).to_numpy() for k in (3, 4)), batch.column(5).to_numpy().astype(np.int64), batch.column(6).to_numpy(), np.frombuffer(b"".join(batch.column(7).to_pylist()), np.uint8).reshape(batch.num_rows, -1)]
            waiting = now if waiting is None else [np.concatenate(x) for x in zip(waiting, now)]
            last = np.flatnonzero(np.any(waiting[0] != waiting[0][-1], axis=1))
            if len(last):
                yield from together(emit([c[: last[-1] + 1] for c in waiting]))
                waiting = [c[last[-1] + 1 :] for c in waiting]
        if waiting is not None:
            yield from together(emit(waiting))

    pairs = dealt.mapInArrow(run, out).groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.first("na").alias("na"), F.first("nb").alias("nb"), F.first("differ").alias("differ"))
    pairs = pairs.where(F.col("c") >= least_shared(F.col("na"), F.col("nb"), light))
    if best == 1:
        both = pairs.select("a", "b", "c", "differ").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "c", "differ"))
        own = both.groupBy("b").agg(F.max_by("a", F.struct("c", -F.col("differ"), "a")).alias("a"))
        return own.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.select("a", "b")


def join_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_task: int = 1_500_000) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest identifier reachable by links).

    Null and empty texts have no shingles and are alone.  Repeated rows and copies share a
    class.  A null identifier counts as larger than any other: a class of such rows alone has a null
    component_id.  Sets are told apart by 64-bit hashes of their shingles.  Very long texts
    are cut into shingles whole, one text at a time; other columns are ignored, whatever their names; an empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    documents, order = survey(plain)
    sizes = documents.groupBy(F.least("n", F.lit(255)).alias("n")).agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("all")).collect()
    light = boundary({r.n: r.c for r in sizes})
    sets = spill(documents.where("n > 0").groupBy("sid").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bitmap").alias("bitmap"), F.count(F.lit(1)).alias("copies")), "sets")
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    entries = signatures(plain, order, light)
    expected = sum(r.all * (DENOMINATOR - NUMERATOR) // DENOMINATOR + 2 * r.c for r in sizes)
    tasks = max(shuffles, -(-expected // rows_per_task))
    led = spill(lead(entries.repartition(tasks, "key").sortWithinPartitions("key", "n", "sid")), "lists")
    # first each set with the leader that it shares most lists with
    counted = led.where("key is null").groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("na"), F.first("m").alias("nb"))
    counted = counted.where(F.col("c") >= least_shared(F.col("na"), F.col("nb"), light))
    pairs = counted.groupBy("b").agg(F.max_by("a", F.struct("c", "a")).alias("a")).select("a", "b")
    edges = linked(plain, pairs, sets, True).select(F.col("a").alias("u"), F.col("b").alias("v"))
    roots = components(edges)
    lists = led.where("key is not null").select("key", "a", "n")
    # then between components: the best partner of each set while that links more, at last, always, all that may link
    idle = False
    for best in (1, 1, 1, None):
        if idle and best is not None:
            continue  # the same proposals again
        more = spill(unfinished(lists, roots, sets, light, best), "more")
        rest = spill(linked(plain, more, sets, False), "rest") if more.head(1) else None
        idle = rest is None or not rest.head(1)
        if idle:
            continue
        forest = roots.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))
        roots = components(forest.unionByName(rest.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    placed = sets.select("sid", "id").join(roots.withColumnRenamed("node", "sid"), "sid")
    least = placed.groupBy("root").agg(F.min("id").alias("least"))
    linked_sets = placed.join(least, "root").select("sid", F.col("least").alias("class"))
    alone = sets.join(roots.select(F.col("node").alias("sid")), "sid", "left_anti").select("sid", F.col("id").alias("class"))
    classes = spill(linked_sets.unionByName(alone), "classes")
    # sets with more than a 4096th of all rows, 4096 at most, are broadcast, so that no set's copies meet in one task
    total = sum(r.c for r in sizes)
    hot = F.broadcast(classes.join(sets.where(F.col("copies") * 4096 > total).select("sid"), "sid").withColumnRenamed("class", "hot"))
    full = documents.where("n > 0").join(hot.withColumn("is_hot", F.lit(True)), "sid", "left")
    known = full.where("is_hot").select("id", "n", F.col("hot").alias("class"))
    cold = full.where("is_hot IS NULL").select("sid", "id", "n").join(classes, "sid").select("id", "n", "class")
    empty = documents.where("n = 0").select("id", "n", F.col("id").alias("class"))
    return known.unionByName(cold).unionByName(empty).select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.col("class").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their class (its smallest identifier), all columns as they were.

    Null and empty texts are classes of their own and stay; rows that share an identifier, a null one included, stay or go together; an empty table stays empty.
    """
    kept = join_classes(docs, id_col, text_col).where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("_id")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("_own"))
    return rows.join(kept, F.col("_own").eqNullSafe(F.col("_id")), "left_semi").select("row.*")
