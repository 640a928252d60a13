"""Overlaps of entities counted entity by entity, from packed lists of the members of each basis key.

A self-join on the basis makes a row for each pair and shared key, and all of these are shuffled. Here each key's
members and their degrees are packed to two or three bytes each, every member gets the packed lists of its keys, and one
task counts, compares and cuts whom an entity meets, in batches of whole entities. What is shuffled is a row per
interaction, and what is made of an entity's candidates needs no further shuffle.

Used where no key has more than ``Skew.wide`` members and no entity more than ``Skew.block`` keys, which bounds what one
entity can meet; the results are those of the joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covote.operators.skew import Skew, most_rows

ROWS = 50_000  # interactions packed at a time
BYTES = 1 << 21  # of packed lists that are unpacked or passed on at a time
STRONG = 16  # candidates by which others are put aside, besides the n looked for
COARSE = 20  # bits of a similarity by which all but the best are put aside


def fits(df: DataFrame, entity: str, basis: str, skew: Skew) -> bool:
    """Whether no basis key and no entity is large. Repeated rows may make them look larger."""
    return most_rows(df, basis) <= skew.wide and most_rows(df, entity) <= skew.block


# packing


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of unsigned numbers, seven bits in each, and how many each number has."""
    size = np.ones(len(values), np.int64)
    for k in range(1, 10):
        more = values >= np.uint64(1 << 7 * k)
        if not more.any():
            break
        size += more
    out, first = np.zeros(size.sum(), np.uint8), np.cumsum(size) - size
    for k in range(int(size.max(initial=0))):
        some = size > k
        part = ((values[some] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8)
        out[first[some] + k] = part | ((size[some] > k + 1).astype(np.uint8) << 7)
    return out, size


def numbers(data: np.ndarray) -> np.ndarray:
    """The unsigned numbers of ``varints``."""
    end = np.flatnonzero(data < 128)
    first = np.r_[0, end[:-1] + 1] if len(end) else end
    size = end - first + 1
    out = (data[first] & 127).astype(np.uint64)
    for k in range(1, int(size.max(initial=0))):
        some = size > k
        out[some] |= (data[first[some] + k] & 127).astype(np.uint64) << np.uint64(7 * k)
    return out


def whole(batches: Iterator[pa.RecordBatch], key: str, rows: int) -> Iterator[pa.Table]:
    """Sorted batches in tables of about ``rows`` or more that end where a value of ``key`` ends."""
    held: list[pa.Table] = []
    size = 0
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        size += batch.num_rows
        if size < rows or batch.num_rows == 0:
            continue
        table = pa.concat_tables(held).combine_chunks()
        new = changes(table[key])
        if len(new) > 1:
            yield table.slice(0, new[-1])
            table = table.slice(int(new[-1]))
        held, size = [table], table.num_rows
        rows = rows if len(new) > 1 else 2 * size
    if size:
        yield pa.concat_tables(held).combine_chunks()


def changes(column: pa.ChunkedArray) -> np.ndarray:
    """The places where a new value begins, 0 the first."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    differs = pc.not_equal(column.slice(1), column.slice(0, len(column) - 1))
    return np.r_[0, np.flatnonzero(differs.to_numpy(zero_copy_only=False)) + 1]


def column(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy()


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From ``basis, entity, n, asks``, sorted, to ``src, blob``: for every member that asks all members of its key, itself too."""
    for table in whole(batches, "basis", ROWS):
        entity, n, asks = (column(table, c) for c in ("entity", "n", "asks"))
        starts = changes(table["basis"])
        sizes = np.diff(np.r_[starts, len(entity)])
        gaps = entity.copy()
        gaps[1:] -= entity[:-1]
        gaps[starts] = (entity[starts] << 1) ^ (entity[starts] >> 63)  # the first may be below zero
        values = np.empty(2 * len(entity), np.uint64)
        values[0::2], values[1::2] = gaps.view(np.uint64), n.astype(np.uint64)
        data, size = varints(values)
        bounds = np.r_[0, np.cumsum(size)[2 * (starts + sizes) - 1]].astype(np.int32)
        blobs = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        of = np.repeat(np.arange(len(starts)), sizes)
        wanted = np.flatnonzero(asks & (sizes[of] > 1))
        part = np.cumsum(np.diff(bounds)[of[wanted]], dtype=np.int64) // BYTES
        for some in np.split(wanted, np.flatnonzero(np.diff(part)) + 1):
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(entity[some]), blobs.take(pa.array(of[some]))], ["src", "blob"])


def packed(lo: DataFrame, hi: DataFrame, degree: DataFrame) -> DataFrame:
    """``src, blob``: the lists of the keys of all ``lo`` asks for among the pairs ``hi``, both ``entity, basis``."""
    rows = hi.join(degree, "entity")
    if lo is hi:
        rows = rows.withColumn("asks", F.lit(True))
    else:
        rows = rows.join(lo.withColumn("asks", F.lit(True)), ["entity", "basis"], "left")
    rows = rows.select("basis", "entity", "n", F.coalesce("asks", F.lit(False)).alias("asks"))
    return rows.repartition("basis").sortWithinPartitions("basis", "entity").mapInArrow(pack, "src long, blob binary")


# unpacking


@dataclass
class Met:
    """Whom some entities meet: ``src`` of each, and for each feature the pairs ``key`` (place in ``src`` and id) and their ``sim``."""

    src: np.ndarray
    keys: list[np.ndarray]
    sims: list[np.ndarray]
    bits: int
    ids: np.ndarray | int  # of the codes in the keys, or the least one

    def split(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place in ``src`` and the id of the other."""
        s, code = key >> self.bits, key & ((1 << self.bits) - 1)
        return s, code + self.ids if isinstance(self.ids, int) else self.ids[code]

    def side_by_side(self) -> tuple[np.ndarray, np.ndarray]:
        """The keys met by any feature, and a row of similarities for each feature, NaN where it has none."""
        if len(self.keys) == 1:
            return self.keys[0], self.sims[0][None, :]
        every = np.unique(np.concatenate(self.keys))
        values = np.full((len(self.keys), len(every)), np.nan)
        for row, key, sim in zip(values, self.keys, self.sims, strict=True):
            row[np.searchsorted(every, key)] = sim
        return every, values


def met(rows: pa.Table, features: int) -> Met:
    """Counts the overlaps of the ``src`` of ``rows``, which are ``src, f, blob`` and sorted."""
    starts = changes(rows["src"])
    src = column(rows, "src")[starts]
    blob = rows["blob"].chunk(0)
    bounds = np.frombuffer(blob.buffers()[1], np.int32)[blob.offset : blob.offset + len(blob) + 1].astype(np.int64)
    data = np.frombuffer(blob.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    values, ends = numbers(data), np.r_[0, np.cumsum(data < 128)][bounds - bounds[0]]
    ids, n = values[0::2].astype(np.int64), values[1::2].astype(np.int64)
    first, members = ends[:-1] // 2, np.diff(ends) // 2
    head = values[0::2][first]
    ids[first] = (head >> np.uint64(1)).astype(np.int64) ^ -(head & np.uint64(1)).astype(np.int64)
    total = np.cumsum(ids)  # wraps around where ids are far apart, and back
    ids = total - np.repeat(total[first] - ids[first], members)
    place = np.repeat(np.repeat(np.arange(len(src)), np.diff(np.r_[starts, rows.num_rows])), members)
    feature = np.repeat(column(rows, "f"), members) if features > 1 else None

    least = int(ids.min())
    bits = max(1, (int(ids.max()) - least).bit_length())
    more = int(n.max()).bit_length()
    known: np.ndarray | int = least
    if len(src).bit_length() + bits + more > 62:
        known, codes = np.unique(ids, return_inverse=True)
        bits = max(1, len(known).bit_length())
        own = np.searchsorted(known, src)
    else:
        codes, own = ids - least, src - least
    mine = (np.arange(len(src)) << bits) + own
    keys, sims = [], []
    for f in range(features):
        some = slice(None) if feature is None else feature == f
        key = ((place[some] << bits) + codes[some] << more) + n[some]
        key.sort()
        pair = key >> more
        new = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]][: len(pair)])
        common, pair, degree = np.diff(np.r_[new, len(key)]).astype(np.float64), pair[new], (key[new] & ((1 << more) - 1)).astype(np.float64)
        # every entity is a member of its own lists
        own_at = np.searchsorted(pair, mine)
        there = own_at < len(pair)
        there[there] = pair[own_at[there]] == mine[there]
        degrees = np.zeros(len(src))
        degrees[there] = degree[own_at[there]]
        other = np.ones(len(pair), bool)
        other[own_at[there]] = False
        pair, common, degree = pair[other], common[other], degree[other]
        keys.append(pair)
        sims.append(np.sqrt(common * common / (degrees[pair >> bits] * degree)))
    return Met(src, keys, sims, bits, known)


def in_parts(batches: Iterator[pa.RecordBatch], features: int) -> Iterator[Met]:
    for table in whole(batches, "src", 1):
        starts = changes(table["src"])
        size = pc.binary_length(table["blob"]).to_numpy().astype(np.int64)
        part = np.add.reduceat(size, starts).cumsum() // BYTES
        cuts = np.r_[starts[np.r_[True, np.diff(part) != 0]], table.num_rows].tolist()
        for a, b in zip(cuts, cuts[1:]):
            yield met(table.slice(a, b - a).combine_chunks(), features)


# what is made of whom an entity meets: of a ``Met`` the columns of the result

Kernel = Callable[[Met], list[pa.Array]]


def _values(row: np.ndarray) -> pa.Array:
    return pa.array(row, mask=np.isnan(row))


def matrix(m: Met) -> list[pa.Array]:
    """``src, dst, f0, …``: all pairs."""
    keys, values = m.side_by_side()
    s, dst = m.split(keys)
    return [pa.array(m.src[s]), pa.array(dst), *map(_values, values)]


def nth(s: np.ndarray, value: np.ndarray, n: int, count: int) -> np.ndarray:
    """The n-th greatest ``value`` (0 to 1) for each of ``count`` places, or less than all where there are not so many; ``s`` is sorted."""
    out = np.full(count, -np.inf)
    if len(s) == 0:
        return out
    rough = (s << COARSE + 1) + ((1 << COARSE) - (value * (1 << COARSE)).astype(np.int64))
    each = np.bincount(s, minlength=count)
    first, full = np.cumsum(each) - each, each >= n
    limit = np.full(count, np.iinfo(np.int64).max)
    limit[full] = np.sort(rough)[first[full] + n - 1]
    near = np.flatnonzero((rough <= limit[s]) & full[s])
    order = near[np.lexsort((-value[near], s[near]))]
    left = np.bincount(s[order], minlength=count)
    first = np.cumsum(left) - left
    out[full] = value[order][first[full] + n - 1]
    return out


def ranks(group: np.ndarray, value: np.ndarray, ties: bool) -> np.ndarray:
    """Places from 1 within runs of ``group``, whose values fall; with ties equals share one. ``group`` says where one begins."""
    at = np.arange(len(group))
    start = np.maximum.accumulate(np.where(group, at, 0))
    if not ties:
        return at - start + 1
    new = group | np.r_[True, value[1:] != value[:-1]][: len(value)]
    return np.maximum.accumulate(np.where(new, at, 0)) - start + 1


def best(n: int, ties: bool) -> Kernel:
    """``src, dst, sim, rank``: the n most similar."""

    def kernel(m: Met) -> list[pa.Array]:
        s, dst = m.split(m.keys[0])
        some = m.sims[0] >= nth(s, m.sims[0], n, len(m.src))[s]
        s, dst, sim = s[some], dst[some], m.sims[0][some]
        order = np.lexsort((dst, -sim, s))
        s, dst, sim = s[order], dst[order], sim[order]
        rank = ranks(np.r_[True, s[1:] != s[:-1]][: len(s)], sim, ties)
        keep = rank <= n
        return [pa.array(m.src[s[keep]]), pa.array(dst[keep]), pa.array(sim[keep]), pa.array(rank[keep].astype(np.int32))]

    return kernel


def best_by_feature(n: int) -> Kernel:
    """``src, dst, f0, …`` of those among the n most similar by a feature, with ties, and by which."""

    def kernel(m: Met) -> list[pa.Array]:
        keys, values = m.side_by_side()
        s, dst = m.split(keys)
        for row in values:
            has = ~np.isnan(row)
            least = nth(s[has], row[has], n, len(m.src))
            row[has] = np.where(row[has] >= least[s[has]], row[has], np.nan)
        some = ~np.isnan(values).all(axis=0)
        return [pa.array(m.src[s[some]]), pa.array(dst[some]), *(_values(row[some]) for row in values)]

    return kernel


def thin(n: int, zero: bool) -> Kernel:
    """``src, dst, f0, …`` without candidates with n better ones that differ from them in one feature only, see ``pareto._thin``.

    Where an absent feature is zero, also without those that n of the strongest dominate: they are never reached, and
    whatever they dominate these n dominate too.
    """

    def behind(values: np.ndarray) -> np.ndarray:
        strongest = values[:, np.argsort(-values.sum(axis=0), kind="stable")[: n + STRONG]]
        pairs = strongest[:, :, None], values[:, None, :]
        return ((pairs[0] >= pairs[1]).all(axis=0) & (pairs[0] > pairs[1]).any(axis=0)).sum(axis=0) >= n

    def kernel(m: Met) -> list[pa.Array]:
        absent = 0.0 if zero else -1.0  # below every cosine
        keys, values = m.side_by_side()
        s, dst = m.split(keys)
        values = np.where(np.isnan(values), absent, values)
        for f in range(len(values)):
            others = np.delete(values, f, axis=0)
            alone = (others == absent).all(axis=0) & (values[f] != absent)  # nearly all of them
            least = nth(s[alone], values[f][alone], n, len(m.src))
            left = ~alone | (values[f] >= least[s])
            s, dst, values, others = s[left], dst[left], values[:, left], others[:, left]
            null = (values[f] == absent) & (not zero)
            order = np.lexsort((-values[f], null, *others, s))
            v = values[f][order]
            new = reduce(np.logical_or, [x[order][1:] != x[order][:-1] for x in (s, null, *others)])
            keep = np.sort(order[ranks(np.r_[True, new][: len(s)], v, True) <= n])
            s, dst, values = s[keep], dst[keep], values[:, keep]
        if zero:
            left = np.ones(len(s), bool)
            cuts = np.r_[np.flatnonzero(np.r_[True, s[1:] != s[:-1]][: len(s)]), len(s)].tolist()
            for a, b in zip(cuts, cuts[1:]):
                if b - a > n:
                    left[a:b] = ~behind(values[:, a:b])
            s, dst, values = s[left], dst[left], values[:, left]
        return [pa.array(m.src[s]), pa.array(dst), *(_values(row if zero else np.where(row == absent, np.nan, row)) for row in values)]

    return kernel


def _dominator(x: np.ndarray, y: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which candidates some other one dominates, and the id of one that does; ids rise. See ``pareto.dominance_witnesses``."""
    has_x, has_y = ~np.isnan(x), ~np.isnan(y)
    both = has_x & has_y
    found, by = np.zeros(len(x), bool), np.zeros(len(x), np.int64)

    def greatest(of: np.ndarray, value: np.ndarray) -> tuple[float, int]:
        at = np.flatnonzero(of)
        if len(at) == 0:
            return -np.inf, 0
        k = at[np.argmax(value[at])]
        return value[k], dst[k]

    for only, value, of in ((has_x & ~has_y, x, has_x), (has_y & ~has_x, y, has_y)):
        most, id_ = greatest(of, value)
        beaten = only & (np.where(only, value, 0) < most)
        found |= beaten
        by[beaten] = id_
    at = np.flatnonzero(both)
    if len(at) == 0:
        return found, by
    at = at[np.lexsort((-y[at], -x[at]))]
    high = np.maximum.accumulate(y[at])
    new = np.r_[True, high[1:] > high[:-1]]
    lead = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
    beaten = (y[lead] > y[at]) | ((y[lead] == y[at]) & (x[lead] > x[at]))
    found[at], by[at] = beaten, dst[lead]
    for of, value in ((has_x & ~has_y, x), (has_y & ~has_x, y)):
        most, id_ = greatest(of, value)
        more = both & ~found & (np.where(both, value, 0) < most)
        found |= more
        by[more] = id_
    return found, by


def dominators(zero: bool) -> Kernel:
    """``src, dst, by``: a dominator of each dominated candidate, of one or two features."""

    def kernel(m: Met) -> list[pa.Array]:
        keys, values = m.side_by_side()
        s, dst = m.split(keys)
        if zero:
            values = np.where(np.isnan(values), 0.0, values)
        x, y = values if len(values) == 2 else (values[0], np.full(len(keys), np.nan))
        found, by = np.zeros(len(s), bool), np.zeros(len(s), np.int64)
        cuts = np.r_[np.flatnonzero(np.r_[True, s[1:] != s[:-1]][: len(s)]), len(s)].tolist()
        for a, b in zip(cuts, cuts[1:]):
            found[a:b], by[a:b] = _dominator(x[a:b], y[a:b], dst[a:b])
        return [pa.array(m.src[s[found]]), pa.array(dst[found]), pa.array(by[found])]

    return kernel


# plans


@dataclass(frozen=True)
class Packed:
    """Packed lists ``src, f, blob`` of so many features, from which each operator counts on its own."""

    rows: DataFrame
    features: int

    def made(self, kernel: Kernel, schema: str) -> DataFrame:
        features, names = self.features, [c.split()[0] for c in schema.split(", ")]

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for m in in_parts(batches, features):
                yield pa.RecordBatch.from_arrays(kernel(m), names)

        return self.rows.repartition("src").sortWithinPartitions("src", "f").mapInArrow(counted, schema)

    def by_feature(self, kernel: Kernel) -> DataFrame:
        return self.made(kernel, ", ".join(["src long, dst long", *(f"f{i} double" for i in range(self.features))]))


_known: WeakKeyDictionary = WeakKeyDictionary()


def side_by_side(parts: list[DataFrame]) -> Packed:
    rows = [part.select("src", F.lit(i).alias("f"), "blob") for i, part in enumerate(parts)]
    return Packed(reduce(DataFrame.unionByName, rows), len(parts))


def feature_matrix(parts: list[DataFrame]) -> DataFrame:
    """``src, dst, f0, …`` of the packed lists of each feature; operators on it find these by ``packed_of``."""
    lists = side_by_side(parts)
    sims = lists.by_feature(matrix)
    _known[sims] = lists
    return sims


def packed_of(sims: DataFrame) -> Packed | None:
    """The packed lists that the matrix ``sims`` is made of, where it is."""
    return _known.get(sims)
