"""Mutual information by nearest neighbours, for feature tables of any size.

Features (and a numeric target) are divided by their standard deviation and
moved by a tiny noise, hashed from the row, that tells equal values apart.

Values travel packed: a block holds the numbers of many rows that go to the
same range of a feature, and a range is sorted in the task that owns it.

Class target: a row's radius is the distance to its k-th nearest neighbour
among the rows of its class. A range holds the values of all classes; of each
class the k values beyond its borders come as a halo. What counts is how many
rows of any class lie nearer than the radius. (A target of so many classes
that their halos would not fit the driver is sorted by feature, class and
value instead.)

Numeric target: the radius is the distance (larger of the two differences) to
the k-th nearest row in the plane of feature and target. The plane is cut into
slabs of the target of bounded rows. Within a slab neighbours are searched in
strips of the feature: rows next to each other in a strip bound the radius,
then the rows of all strips within the bound are looked at. Rows whose radius
reaches over the slab's border ask the slabs they reach. What counts is how
many rows lie nearer than the radius in the feature, and in the target.

Counts are ranks of the two ends of a row's interval: an end goes to the range
that it lies in, and its rank there comes back to the row. Ends in a row's own
range (own slab for the target) are ranked on the spot.

Features are taken in groups of about ``GROUP_ROWS`` values, whose tables are
freed before the next group; the disk holds one group beside the staged rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.columns import q, sql_finite, sql_lit
from tabloom.session import stage_columns

K = 3
NOISE = 1e-10
UNIT_ROWS = 1 << 17         # rows of a slab of the plane, about
WINDOW = 8                  # rows on both sides in a strip that bound the radius
CELLS = 1 << 20             # distances held at once
RANGE_ROWS = 1 << 18        # values of a range, about
PACK_ROWS = 1 << 19         # rows that are packed at once
PART_ROWS = 1 << 20         # rows of a range partition, about
GROUP_ROWS = 20_000_000      # values of the features taken together, about
GROUP_FEATURES = 8          # and features: the noise of many makes code too long to be compiled
MANY_HALOS = 1 << 18        # classes times ranges of a group beyond which rows are sorted by class
EDGE_VALUES = 256           # values at each end of a partition that the index holds
GAPS = 64                   # widest gaps of a partition that the index holds


def digamma(n: np.ndarray) -> np.ndarray:
    """The digamma function for positive numbers, to double precision."""
    x, out = np.asarray(n, float).copy(), 0.0
    out = np.zeros_like(x)
    while (low := x < 10).any():
        out[low] -= 1 / x[low]
        x[low] += 1
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


_PSI = digamma(np.arange(1, (1 << 16) + 1))


def _psi_sum(m: np.ndarray) -> float:
    """Sum of digamma of counts; a count below 1 is taken as 1."""
    m = np.maximum(m, 1)
    small = m <= len(_PSI)
    return float(_PSI[m[small] - 1].sum() + digamma(m[~small]).sum())


def scaled_rows(df: DataFrame, features: list[str], target: str, discrete: bool,
                fill: dict[str, float] | None = None) -> DataFrame:
    """(id, x0 .. xn, y) over staged rows: scaled values with their noise; y is a class as text or a scaled number.

    Missing and infinite features take ``fill`` (default 0); rows without a
    (finite) target go.
    """
    fill = fill or {}
    raw = df.selectExpr(*[f"coalesce({sql_finite(df, c)}, {sql_lit(float(fill.get(c) or 0.0))}) AS x{k}"
                          for k, c in enumerate(features)],
                        (f"CAST({q(target)} AS STRING)" if discrete else sql_finite(df, target)) + " AS y").where("y IS NOT NULL")
    raw = stage_columns(raw.withColumn("id", F.monotonically_increasing_id()))
    numbers = [f"x{k}" for k in range(len(features))] + ([] if discrete else ["y"])
    stats = raw.selectExpr(*[e for c in numbers for e in (f"stddev_pop({c}) AS s_{c}", f"avg(abs({c})) AS m_{c}")]).first()

    def moved(k: int, c: str) -> str:
        s = stats[f"s_{c}"] or 1.0
        size = max(1.0, (stats[f"m_{c}"] or 0.0) / s)
        even = lambda j: f"((pmod(xxhash64(id, {k}, {j}), 4503599627370496L) + 0.5D) / 4503599627370496D)"
        return f"{c} / {sql_lit(s)} + {sql_lit(NOISE * size)} * sqrt(-2 * ln({even(1)})) * cos(2 * pi() * {even(2)}) AS {c}"
    return raw.selectExpr("id", *[moved(k, c) for k, c in enumerate(numbers)], *(["y"] if discrete else []))


def _first_beyond(x: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Smallest v with v - x >= d, by the difference as computed: bisection over the doubles in order."""
    sign = np.uint64(1 << 63)

    def place(v):
        bits = v.view(np.uint64)
        return np.where(bits & sign, ~bits, bits | sign)

    def value(k):
        return np.where(k & sign, k ^ sign, ~k).view(np.float64)
    slack = 4 * np.spacing(np.maximum(np.abs(x), np.abs(x + d)) + d)
    lo, hi = place(x + d - slack), place(x + d + slack)     # beyond is false at lo, true at hi
    while (hi - lo > 1).any():
        mid = lo + ((hi - lo) >> np.uint64(1))
        beyond = value(mid) - x >= d
        hi, lo = np.where(beyond, mid, hi), np.where(beyond, lo, mid)
    return value(hi)


def _ends(x: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest value at least d below x, and smallest at least d above, by the differences as computed."""
    return -_first_beyond(-x, d), _first_beyond(x, d)


def _whole(batches) -> list[np.ndarray]:
    """The columns of a task's rows."""
    cols = None
    for b in batches:
        part = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        cols = [[x] for x in part] if cols is None else [[*a, x] for a, x in zip(cols, part)]
    return [np.concatenate(c) for c in cols] if cols else []


def _parts(spark, rows: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // PART_ROWS))


class _Kept:
    """Tables of a group, on disk until the group is done."""

    def __init__(self):
        self.tables: list[DataFrame] = []

    def __call__(self, df: DataFrame) -> DataFrame:
        self.tables.append(df.persist(StorageLevel.DISK_ONLY))
        return df

    def free(self) -> None:
        for df in self.tables:
            df.unpersist(blocking=True)
        if self.tables:     # shuffle files go once the driver's JVM has dropped their plans
            self.tables[0].sparkSession.sparkContext._jvm.System.gc()
        self.tables.clear()


def _sorted(kept: _Kept, df: DataFrame, n: int, *order: str) -> DataFrame:
    """``df`` in range partitions of ``order``, sorted, with the partition's number as ``part``."""
    return kept(df.repartitionByRange(_parts(df.sparkSession, n), *order).sortWithinPartitions(*order)
                .withColumn("part", F.spark_partition_id()))


def _runs(f: np.ndarray):
    """(start, end) of the runs of equal numbers."""
    start = np.flatnonzero(np.r_[True, f[1:] != f[:-1]])
    return list(zip(start.tolist(), np.r_[start[1:], len(f)].tolist()))


def _indexed(x: np.ndarray, edge: int, gaps: int) -> np.ndarray:
    """Places of the sorted ``x`` that the index holds: ``edge`` at both ends, and both sides of the widest gaps."""
    n = len(x)
    if n <= 2 * (edge + gaps):
        return np.arange(n)
    gap = np.argpartition(np.diff(x), n - 1 - gaps)[-gaps:]
    return np.unique(np.r_[np.arange(edge), np.arange(n - edge, n), gap, gap + 1])


def _index(placed: DataFrame):
    """({f: (values, their ranks, number of all values)}, {(part, f): values before the partition})."""
    edge, gaps = EDGE_VALUES, GAPS

    def look(batches):
        import pyarrow as pa
        cols = _whole(batches)
        if cols:
            f, v, part = cols
            out = [(int(part[0]), int(f[a]), b - a, at.astype(np.int64).tobytes(), v[a:b][at].tobytes())
                   for a, b in _runs(f) for at in [_indexed(v[a:b], edge, gaps)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                             names=["part", "f", "n", "at", "v"])
    seen = placed.select("f", "v", "part").mapInArrow(look, "part int, f int, n long, at binary, v binary").collect()
    before: dict[tuple[int, int], int] = {}
    values: dict[int, list] = {}
    total: dict[int, int] = {}
    for part, f, n, at, v in sorted(map(tuple, seen)):
        before[part, f] = total.get(f, 0)
        values.setdefault(f, []).append((np.frombuffer(v), np.frombuffer(at, np.int64) + before[part, f]))
        total[f] = before[part, f] + n
    return {f: (*map(np.concatenate, zip(*v)), total[f]) for f, v in values.items()}, before


def _below(end: np.ndarray, side: str, x: np.ndarray, start: int, index) -> np.ndarray:
    """How many values lie below the ends (side left), or not above them (right); -1 if neither the own partition's
    sorted values ``x``, of rank ``start`` on, nor the index tells."""
    known, rank, total = index
    at = np.searchsorted(known, end, side)
    upper = np.r_[rank, total][at]
    told = (at == 0) | (at == len(known)) | (upper == rank[np.maximum(at - 1, 0)] + 1)
    own = (x[0] <= end) & (end <= x[-1])
    return np.where(own, start + np.searchsorted(x, end, side), np.where(told, upper, -1))


FOUND = "f int, id long, kind int, v double, m long, d double"      # kind 0: m values < v; 2: m values <= v; 3: m; 4: sums


def near_counts(kept: _Kept, points: DataFrame, n_points: int) -> dict[int, tuple[int, float]]:
    """f -> (rows, sum of digamma(m)) of ``points`` (f, v, d, id): m is how many values of f lie nearer than d to v."""
    placed = _sorted(kept, points.select("f", "v", "d", "id"), n_points, "f", "v")
    known, before = _index(placed)
    shared = placed.sparkSession.sparkContext.broadcast((known, before))

    def count(batches):
        import pyarrow as pa
        cols = _whole(batches)
        if not cols:
            return
        known, before = shared.value
        f, v, d, ids, part = cols
        for a, b in _runs(f):
            g = int(f[a])
            x, start, id_ = v[a:b], before[int(part[0]), g], ids[a:b]
            lo, hi = _ends(x, d[a:b])
            m = [_below(hi, "left", x, start, known[g]), _below(lo, "right", x, start, known[g])]
            sure = (m[0] >= 0) & (m[1] >= 0)
            rows = [(np.full(1, -1), 4, np.zeros(1), np.array([sure.sum()]),
                     np.array([digamma(np.maximum(m[0] - m[1], 1)[sure]).sum()]))]
            for kind, end, k, sign in ((0, hi, m[0], 1), (2, lo, m[1], -1)):
                asked, half = k < 0, (k >= 0) & ~sure
                rows.append((id_[asked], kind, end[asked], np.zeros(asked.sum()), np.zeros(asked.sum())))
                rows.append((id_[half], 3, np.zeros(half.sum()), sign * k[half], np.zeros(half.sum())))
            size = [len(r[0]) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(sum(size), g, np.int32)), pa.array(np.concatenate([r[0] for r in rows]).astype(np.int64)),
                 pa.array(np.repeat([r[1] for r in rows], size).astype(np.int32)), pa.array(np.concatenate([r[2] for r in rows])),
                 pa.array(np.concatenate([r[3] for r in rows]).astype(np.int64)), pa.array(np.concatenate([r[4] for r in rows]))],
                names=[c.split()[0] for c in FOUND.split(", ")])
    found = kept(placed.mapInArrow(count, FOUND))
    out = {r["f"]: (r["n"], r["d"]) for r in found.where("kind = 4").groupBy("f").agg(
        F.sum("m").alias("n"), F.sum("d").alias("d")).collect()}
    asked = found.where("kind IN (0, 2)")
    if n_asked := asked.count():
        told = _row_ranks(kept, placed.selectExpr("f", "v", "1 AS kind", "id").union(asked.select("f", "v", "kind", "id")),
                      n_points + n_asked)
        counts = told.union(found.where("kind = 3").select("f", "id", "m")).groupBy("f", "id").agg(F.sum("m").alias("m"))
        for f, (n, d) in _mean_digamma(counts).items():
            out[f] = (out[f][0] + n, out[f][1] + d)
    shared.unpersist()
    return out


def _row_ranks(kept: _Kept, events: DataFrame, n_events: int) -> DataFrame:
    """(f, id, m) of the ends among ``events`` (f, v, kind, id): m = values < v for kind 0, -(values <= v) for kind 2;
    kind 1 are the values."""
    placed = _sorted(kept, events, n_events, "f", "v", "kind")
    before: dict[tuple[int, int], int] = {}
    sums: dict[int, int] = {}
    for r in sorted(placed.groupBy("part", "f").agg(F.count_if(F.col("kind") == 1).alias("n")).collect()):
        before[r["part"], r["f"]] = sums.get(r["f"], 0)
        sums[r["f"]] = sums.get(r["f"], 0) + r["n"]

    def count(batches):
        import pyarrow as pa
        cols = _whole(batches)
        if not cols:
            return
        f, kind, ids, part = cols
        for a, b in _runs(f):
            asked = np.flatnonzero(kind[a:b] != 1)
            rank = before[int(part[0]), int(f[a])] + np.cumsum(kind[a:b] == 1)[asked]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(asked), f[a], np.int32)), pa.array(ids[a:b][asked]),
                 pa.array(np.where(kind[a:b][asked] == 0, rank, -rank).astype(np.int64))], names=["f", "id", "m"])
    return placed.select("f", "kind", "id", "part").mapInArrow(count, "f int, id long, m long")


def _mean_digamma(counts: DataFrame) -> dict[int, tuple[int, float]]:
    """f -> (rows, sum of digamma(m))."""
    def run(batches):
        import pyarrow as pa
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digamma(np.maximum(b.column(1).to_numpy(), 1)))],
                                             names=["f", "d"])
    rows = counts.select("f", "m").mapInArrow(run, "f int, d double").groupBy("f").agg(
        F.count("*").alias("n"), F.sum("d").alias("d")).collect()
    return {r["f"]: (r["n"], r["d"]) for r in rows}


# ── packed ranges ────────────────────────────────────────────────────────────

BLOCKS = "kind int, f int, at int, origin int, n long, d double, a binary, b binary, c binary"
NAMES = [c.split()[0] for c in BLOCKS.split(", ")]
VALUES, ENDS, RANKS, SUMS, ASKED, OPEN = range(6)      # kinds of blocks


def _block(kind: int, f: int, at: int, *arrays, origin: int = 0, n: int = 0, d: float = 0.0) -> tuple:
    return (kind, f, at, origin, n, d, *(np.ascontiguousarray(v).tobytes() for v in arrays), *[b""] * (3 - len(arrays)))


def _blocks_out(out: list[tuple], batch: bool = False):
    import pyarrow as pa
    kinds = [pa.int32()] * 4 + [pa.int64(), pa.float64()] + [pa.binary()] * 3
    cols = [pa.array(c, k) for c, k in zip(list(zip(*out)) or [[] for _ in kinds], kinds)]
    return (pa.RecordBatch if batch else pa.Table).from_arrays(cols, names=NAMES)


def _cells(table, kind: int) -> list[dict]:
    """The blocks of a kind, in an order that does not depend on how they came."""
    import pyarrow.compute as pc
    return sorted(table.filter(pc.equal(table.column("kind"), kind)).to_pylist(), key=lambda r: (r["origin"], r["a"][:64], r["a"]))


def _joined(blocks: list[dict], name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(r[name] for r in blocks), kind)


def _split(at: np.ndarray):
    """(number, its places) of the numbers in ``at``."""
    by = np.argsort(at.astype(np.uint16) if len(at) and at.max() < 1 << 16 else at, kind="stable")
    return [(int(at[by[a]]), by[a:b]) for a, b in _runs(at[by])] if len(at) else []


def _by_range(df: DataFrame, groups: int) -> DataFrame:
    """Blocks of the same feature and range together, at most ``groups`` of these."""
    return df.repartition(max(1, min(groups, 400)), "f", "at").groupBy("f", "at")


def _cuts(rows: DataFrame, n: int, names: list[str], size: int) -> list[np.ndarray]:
    """Per column the upper borders of ranges of about ``size`` values, but for the last."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) if size == RANGE_ROWS else 1, -(-n // size))
    parts = min(parts, max(1, n // 64))
    if parts < 2:
        return [np.zeros(0) for _ in names]
    probs = [j / parts for j in range(1, parts)]
    return [np.unique(e) for e in rows.approxQuantile(names, probs, 1 / (4 * parts))]


def _packed(rows: DataFrame, columns: list[str], run, codes: dict[str, int] | None = None) -> DataFrame:
    """Blocks of ``run(arrays of the columns)``, which is given many rows at once; text comes as ``codes``, or -1."""
    shared = rows.sparkSession.sparkContext.broadcast(codes)

    def array(c):
        import pyarrow as pa
        if not (pa.types.is_string(c.type) or pa.types.is_large_string(c.type)):
            return c.to_numpy(zero_copy_only=False)
        c = c.dictionary_encode()
        return np.array([shared.value.get(v, -1) for v in c.dictionary.to_pylist()], np.int32)[c.indices.to_numpy()]

    def pack(batches):
        held, size = [], 0

        def out():
            cols = [np.concatenate(c) for c in zip(*held)]
            held.clear()
            return _blocks_out(run(*cols), True)
        for b in batches:
            held.append([array(c) for c in b.columns])
            size += len(b)
            if size * len(columns) >= 8 * PACK_ROWS:
                size = 0
                yield out()
        if held:
            yield out()
    return rows.select(*columns).mapInArrow(pack, BLOCKS)


def _ends_out(f: int, cuts: np.ndarray, origin: int, who: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[tuple]:
    """Blocks of the ends of the rows ``who`` of ``origin``, by the range they lie in; an odd number is an upper end."""
    end = np.concatenate([lo, hi])
    who = np.concatenate([2 * who, 2 * who + 1]).astype(np.int32)
    return [_block(ENDS, f, at, who[r], end[r], origin=origin) for at, r in _split(np.searchsorted(cuts, end))]


def _ranks(blocks: DataFrame, groups: int) -> DataFrame:
    """Of blocks of values and of ends, the ends' ranks: values below an upper end, values not above a lower one, both
    within the end's range (``n``); and per range the number of its values."""
    def rank(table):
        out = []
        values = np.sort(_joined(_cells(table, VALUES), "a", float))
        f, at = table.column("f")[0].as_py(), table.column("at")[0].as_py()
        for r in _cells(table, ENDS):
            who, end = np.frombuffer(r["a"], np.int32), np.frombuffer(r["b"])
            up = who % 2 == 1
            m = np.empty(len(who), np.int32)
            m[up] = np.searchsorted(values, end[up], "left")
            m[~up] = np.searchsorted(values, end[~up], "right")
            out.append(_block(RANKS, f, r["origin"], who, m, origin=at))
        out.append(_block(VALUES, f, at, n=len(values)))
        return _blocks_out(out)
    return _by_range(blocks, groups).applyInArrow(rank, BLOCKS)


def _before(sizes) -> dict[tuple[int, int], int]:
    """(f, range) -> values of the feature before the range, from (f, range, number of values)."""
    out, total = {}, {}
    for f, at, n in sorted(map(tuple, sizes)):
        out[f, at] = total.get(f, 0)
        total[f] = out[f, at] + n
    return out


def _counted(blocks: DataFrame, groups: int, before: dict) -> dict[int, tuple[int, float]]:
    """f -> (rows, sum of digamma(m)) over the rows of blocks of ranks; m is the upper end's rank less the lower end's."""
    shared = blocks.sparkSession.sparkContext.broadcast(before)

    def add(table):
        f = table.column("f")[0].as_py()
        cells = _cells(table, RANKS)
        who = _joined(cells, "a", np.int32)
        m = _joined(cells, "b", np.int32) + np.repeat([shared.value.get((f, r["origin"]), 0) for r in cells],
                                                      [len(r["a"]) // 4 for r in cells])
        size = int(who.max()) // 2 + 1
        up = who % 2 == 1
        count = np.zeros(size, np.int64)
        np.add.at(count, who // 2, np.where(up, m, -m))
        seen = np.zeros(size, bool)
        seen[who // 2] = True
        return _blocks_out([_block(SUMS, f, 0, n=int(seen.sum()), d=_psi_sum(count[seen]))])
    out = _sums(_by_range(blocks, groups).applyInArrow(add, BLOCKS))
    shared.unpersist()
    return out


def _sums(blocks: DataFrame) -> dict[int, tuple[int, float]]:
    return {r["f"]: (r["n"], r["d"]) for r in blocks.where(F.col("kind") == SUMS).groupBy("f").agg(
        F.sum("n").alias("n"), F.sum("d").alias("d")).collect()}


def _add(one: dict, other: dict) -> dict[int, tuple[int, float]]:
    return {f: tuple(map(sum, zip(one.get(f, (0, 0.0)), other.get(f, (0, 0.0))))) for f in {*one, *other}}


# ── class target ─────────────────────────────────────────────────────────────

def _kth(a: np.ndarray, k: int, lo: int, hi: int) -> np.ndarray:
    """Distance to the k-th nearest of the sorted ``a`` for its entries lo .. hi - 1."""
    at = np.arange(lo, hi)
    near = []
    for j in range(1, k + 1):
        left, right = np.maximum(at - j, 0), np.minimum(at + j, len(a) - 1)
        near.append(np.where(at - j >= 0, a[at] - a[left], np.inf))
        near.append(np.where(at + j < len(a), a[right] - a[at], np.inf))
    return np.partition(np.stack(near), k - 1, axis=0)[k - 1]


def _class_terms(rows: DataFrame, k: int) -> tuple[int, float]:
    """Rows whose class has others, and their sum of digamma(neighbours taken) - digamma(class size)."""
    sizes = rows.groupBy("y").count().where("count > 1").groupBy("count").agg(F.count("*").alias("times")).collect()
    size = np.array([r["count"] for r in sizes], float)     # one row per size of a class
    weight = size * np.array([r["times"] for r in sizes], float)
    return int(weight.sum()), float((weight * (digamma(np.minimum(k, size - 1)) - digamma(size))).sum()) if len(size) else 0.0


def _class_codes(rows: DataFrame, n: int) -> dict[str, int] | None:
    """A number for each class of several rows, or None if there are too many for halos."""
    most = MANY_HALOS // (GROUP_FEATURES * max(8, -(-n // RANGE_ROWS)))
    found = rows.groupBy("y").count().where("count > 1").select("y").limit(most + 1).collect()
    return {y: c for c, y in enumerate(sorted(r["y"] for r in found))} if len(found) <= most else None


def _class_scores(kept: _Kept, rows: DataFrame, n: int, which: list[int], k: int, terms: tuple[int, float],
                  labels: dict[str, int] | None) -> dict[int, float]:
    near = _class_counts_by_class(kept, rows, n, which, k) if labels is None else _class_counts(kept, rows, n, which, k, labels)
    m, sum_ = terms
    return {j: max(0.0, float(digamma(np.array([m]))[0]) + (sum_ - near[j][1]) / m) for j in which if j in near}


def _class_counts(kept: _Kept, rows: DataFrame, n: int, which: list[int], k: int, labels: dict[str, int]) -> dict[int, tuple[int, float]]:
    """f -> (rows, sum of digamma(m)): m is how many values lie nearer to a row than the k-th nearest of its class."""
    sc = rows.sparkSession.sparkContext
    cuts = dict(zip(which, _cuts(rows, n, [f"x{j}" for j in which], RANGE_ROWS)))
    groups = sum(len(c) + 1 for c in cuts.values())

    def place(*cols):
        code = cols[-1]
        ok = code >= 0              # rows that are alone in their class take no part
        return [_block(VALUES, j, part, x[ok][r], code[ok][r]) for j, x in zip(which, cols)
                for part, r in _split(np.searchsorted(cuts[j], x[ok]))]

    def sort(table):
        cells = _cells(table, VALUES)
        x, code = _joined(cells, "a", float), _joined(cells, "b", np.int32)
        by = np.lexsort((code, x)) if len(np.unique(x)) < len(x) else np.argsort(x)
        x, code = x[by], code[by]
        halo = []
        for c, r in _split(code):
            v, few = x[r], np.full(k, np.nan)
            low, high = few.copy(), few.copy()
            low[:len(v[:k])], high[:len(v[-k:])] = v[:k], v[-k:]
            halo.append(np.r_[c, len(v), low, high])
        return _blocks_out([_block(VALUES, cells[0]["f"], cells[0]["at"], x, code, np.array(halo), n=len(x))])
    parts = kept(_by_range(_packed(rows, [*(f"x{j}" for j in which), "y"], place, labels), groups).applyInArrow(sort, BLOCKS))
    edge: dict[tuple[int, int], list] = {}
    sizes = []
    for f, at, size, halo in sorted(map(tuple, parts.select("f", "at", "n", "c").collect())):
        sizes.append((f, at, size))
        for h in np.frombuffer(halo).reshape(-1, 2 + 2 * k):
            edge.setdefault((f, int(h[0])), []).append((at, int(h[1]), h[2:2 + k], h[2 + k:]))
    shared = sc.broadcast(edge)

    def count(batches):
        for batch in batches:
            for f, at, xs, cs in zip(*(batch.column(NAMES.index(c)).to_pylist() for c in ("f", "at", "a", "b"))):
                x, code = np.frombuffer(xs), np.frombuffer(cs, np.int32)
                d = np.empty(len(x))
                for c, r in _split(code):
                    others = shared.value[f, c]
                    total = sum(o[1] for o in others)
                    low = np.concatenate([np.zeros(0), *(o[3] for o in others if o[0] < at)])
                    high = np.concatenate([np.zeros(0), *(o[2] for o in others if o[0] > at)])
                    low, high = low[~np.isnan(low)][-k:], high[~np.isnan(high)][:k]
                    d[r] = _kth(np.concatenate([low, x[r], high]), min(k, total - 1), len(low), len(low) + len(r))
                lo, hi = _ends(x, d)
                c = cuts[f]
                here = (np.searchsorted(c, lo) == at) & (np.searchsorted(c, hi) == at)
                m = np.searchsorted(x, hi[here], "left") - np.searchsorted(x, lo[here], "right")
                far = np.flatnonzero(~here)
                yield _blocks_out([_block(SUMS, f, at, n=int(here.sum()), d=_psi_sum(m)),
                                   *_ends_out(f, c, at, far, lo[far], hi[far])], True)
    found = kept(parts.mapInArrow(count, BLOCKS))
    near = _sums(found)
    ends = found.where(F.col("kind") == ENDS)
    if ends.limit(1).count():
        asked = F.broadcast(ends.select("f", "at").distinct())
        ranks = _ranks(parts.join(asked, ["f", "at"], "left_semi").select(*NAMES).unionByName(ends), groups)
        near = _add(near, _counted(ranks.where(F.col("kind") == RANKS), groups, _before(sizes)))
    shared.unpersist()
    return near


def _class_counts_by_class(kept: _Kept, rows: DataFrame, n: int, which: list[int], k: int) -> dict[int, tuple[int, float]]:
    """The same for a target of many classes: rows sorted by (feature, class, value)."""
    spark = rows.sparkSession
    values = F.explode(F.array(*[F.struct(F.lit(j).alias("f"), F.col(f"x{j}").alias("x")) for j in which]))
    long = rows.select("id", F.col("y").alias("label"), values.alias("v")).select("v.f", "label", "v.x", "id")
    placed = _sorted(kept, long, n * len(which), "f", "label", "x")

    def groups(cols):
        f, label = cols[0], cols[1]
        start = np.flatnonzero(np.r_[True, (f[1:] != f[:-1]) | (label[1:] != label[:-1])])
        return zip(start, np.r_[start[1:], len(f)])

    def borders(batches):       # only a partition's first and last group can run on into others
        import pyarrow as pa
        cols = _whole(batches)
        if cols:
            all_ = list(groups(cols))
            for a, b in {all_[0], all_[-1]}:
                x = cols[2][a:b]
                yield pa.RecordBatch.from_pylist([{"part": int(cols[4][0]), "f": int(cols[0][a]), "label": cols[1][a], "n": int(b - a),
                                                   "low": x[:k].tolist(), "high": x[-k:].tolist()}],
                                                 schema=pa.schema([("part", pa.int32()), ("f", pa.int32()), ("label", pa.string()),
                                                                   ("n", pa.int64()), ("low", pa.list_(pa.float64())),
                                                                   ("high", pa.list_(pa.float64()))]))
    kind = "part int, f int, label string, n long, low array<double>, high array<double>"
    edge: dict[tuple, list] = {}
    for r in placed.mapInArrow(borders, kind).collect():
        edge.setdefault((r["f"], r["label"]), []).append((r["part"], r["n"], r["low"], r["high"]))
    shared = spark.sparkContext.broadcast({g: sorted(v) for g, v in edge.items() if len(v) > 1})

    def radii(batches):
        import pyarrow as pa
        cols = _whole(batches)
        if not cols:
            return
        f, label, x, ids, part = cols
        d = np.full(len(x), np.nan)
        for a, b in groups(cols):
            others = shared.value.get((int(f[a]), label[a]), [])
            total = sum(o[1] for o in others) or int(b - a)
            if total < 2:
                continue
            low = [v for o in others if o[0] < part[0] for v in o[3]][-k:]
            high = [v for o in others if o[0] > part[0] for v in o[2]][:k]
            d[a:b] = _kth(np.concatenate([low, x[a:b], high]), min(k, total - 1), len(low), len(low) + int(b - a))
        ok = ~np.isnan(d)
        yield pa.RecordBatch.from_arrays([pa.array(c[ok]) for c in (f, x, d, ids)], names=["f", "v", "d", "id"])
    near = near_counts(kept, placed.mapInArrow(radii, "f int, v double, d double, id long"), n * len(which))
    shared.unpersist()
    return near


# ── numeric target ───────────────────────────────────────────────────────────

def _wider(r: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A little more than r, so that a sum with a value up to ``size`` in magnitude does not round below it."""
    return np.where(np.isfinite(r), r + 8 * np.spacing(size + np.where(np.isfinite(r), r, 0)), r)


def _strip_cuts(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Upper borders of strips of x for rows sorted by y, about as wide as a few rows of a strip are apart in y.

    Values that only the noise tells apart stay in one strip, and values that
    many rows have get one of their own.
    """
    n = len(x)
    wide, high = np.ptp(np.quantile(x, [0.05, 0.95])), y[int(0.95 * (n - 1))] - y[int(0.05 * (n - 1))]
    strips = int(np.clip(math.sqrt(min(wide * n / (6 * high), n * n)) if high > 0 else 64, 64, max(64, n // 32)))
    step = 1e4 * NOISE * max(1.0, float(np.abs(x).max()))
    v, times = np.unique(np.round(np.quantile(x, np.linspace(0, 1, strips + 1)) / step), return_counts=True)
    return np.unique(np.concatenate([v[1:-1] + 0.5, v[times > 1] - 0.5, v[times > 1] + 0.5])) * step


class Plane:
    """Points of the plane by strips of x, each sorted by y; ``py`` is sorted."""

    def __init__(self, px: np.ndarray, py: np.ndarray):
        self.n, self.px, self.py = len(px), px, py
        self.cuts = _strip_cuts(px, py)
        strip = np.searchsorted(self.cuts, px)
        self.order = np.argsort(strip.astype(np.uint16) if len(self.cuts) < 1 << 16 else strip, kind="stable")
        self.x, self.y, self.strip = px[self.order], py[self.order], strip[self.order]
        self.key = self.strip * self.n + self.order         # by strip, then by place in y

    def nearest(self, k: int) -> np.ndarray:
        """rows x k distances (larger difference) of every point to the nearest others."""
        n, far = self.n, np.inf
        near = np.full((n, 2 * WINDOW), far)
        for j in range(1, min(WINDOW, n - 1) + 1):
            d = np.maximum(np.abs(self.x[j:] - self.x[:-j]), self.y[j:] - self.y[:-j])
            d[self.strip[j:] != self.strip[:-j]] = far
            near[:-j, 2 * j - 2] = near[j:, 2 * j - 1] = d
        near = np.partition(near, k - 1, axis=1)[:, :k] if k < near.shape[1] else near
        near = np.sort(near, axis=1)
        bound = near[:, k - 1]
        # Beyond the window a row of the strip is at least as far as in y, one of another strip as the strip's border.
        j = WINDOW + 1
        rest = np.full((2, n), far)
        if n > j:
            d = np.where(self.strip[j:] == self.strip[:-j], self.y[j:] - self.y[:-j], far)
            rest[0, :-j] = rest[1, j:] = d
        border = np.r_[-far, self.cuts, far]
        side = np.minimum(self.x - border[self.strip], border[self.strip + 1] - self.x)
        left = np.flatnonzero(~(bound < np.minimum(side, rest.min(axis=0))))
        if len(left):
            alone = left[~np.isfinite(bound[left])]         # too few in the strip: the rows next in y bound the search
            if len(alone) and n > k:
                at = self.order[alone, None] + np.r_[-WINDOW:0, 1:WINDOW + 1]
                d = np.maximum(np.abs(self.x[alone, None] - self.px[np.clip(at, 0, n - 1)]),
                               np.abs(self.y[alone, None] - self.py[np.clip(at, 0, n - 1)]))
                d[(at < 0) | (at >= n)] = far
                bound[alone] = np.partition(d, k - 1, axis=1)[:, k - 1]
            near[left] = self.within(self.x[left], self.y[left], bound[left], k, left)
        out = np.empty((n, k))
        out[self.order] = near[:, :k]
        return out

    def within(self, x: np.ndarray, y: np.ndarray, reach: np.ndarray, k: int, own: np.ndarray | None = None) -> np.ndarray:
        """rows x k distances of (x, y) to the nearest points not beyond ``reach`` (inf where fewer lie within; some may lie
        a little beyond); ``own`` are the places of rows that are points themselves, and none is its own neighbour."""
        out = np.full((len(x), k), np.inf)
        r = _wider(reach, np.maximum(np.abs(x), np.abs(y)))
        first, last = np.searchsorted(self.cuts, x - r), np.searchsorted(self.cuts, x + r)
        low, high = np.searchsorted(self.py, y - r), np.searchsorted(self.py, y + r, "right")
        strips = last - first + 1
        by = np.argsort(strips, kind="stable")
        for a, b in _chunks(strips[by], CELLS // 4):
            rows = by[a:b]
            size = strips[rows]
            who = np.repeat(np.arange(len(rows)), size)
            s = np.arange(len(who)) - np.repeat(np.cumsum(size) - size, size) + first[rows][who]
            start = np.searchsorted(self.key, s * self.n + low[rows][who])
            many = np.searchsorted(self.key, s * self.n + high[rows][who]) - start
            total = np.bincount(who, many, len(rows)).astype(np.int64)
            head = np.cumsum(size) - size                   # a row's first strip
            order = np.argsort(total, kind="stable")
            for c, d in _chunks(total[order], CELLS, even=True):
                some = order[c:d]
                pieces = np.repeat(head[some], size[some]) + (np.arange(size[some].sum()) - np.repeat(
                    np.cumsum(size[some]) - size[some], size[some]))
                m = many[pieces]
                place = np.repeat(start[pieces] - (np.cumsum(m) - m), m) + np.arange(m.sum())
                row = np.repeat(np.arange(len(some)), total[some])
                col = np.arange(len(row)) - np.repeat(np.cumsum(total[some]) - total[some], total[some])
                q = rows[some]
                dist = np.maximum(np.abs(x[q][row] - self.x[place]), np.abs(y[q][row] - self.y[place]))
                if own is not None:
                    dist[place == own[q][row]] = np.inf
                grid = np.full((len(some), max(k, int(total[some[-1]]))), np.inf)
                grid[row, col] = dist
                out[q] = np.sort(np.partition(grid, k - 1, axis=1)[:, :k], axis=1)
        return out


def _chunks(sizes: np.ndarray, most: int, even: bool = False):
    """(start, end) of runs of the ascending ``sizes`` that add up to about ``most``; if ``even``, each counts as the largest
    of its run, at most twice the first."""
    a = 0
    while a < len(sizes):
        if even:
            b = min(int(np.searchsorted(sizes, max(16, 2 * sizes[a]), "right")), a + max(1, most // max(16, 2 * int(sizes[a]))))
        else:
            b = a + max(1, int(np.searchsorted(np.cumsum(sizes[a:]), most)))
        yield a, (a := max(b, a + 1))


def _number_scores(kept: _Kept, rows: DataFrame, n: int, which: list[int], k: int, slabs: np.ndarray) -> dict[int, float]:
    if n < 2:
        return {j: 0.0 for j in which}
    k = min(k, n - 1)
    cuts = dict(zip(which, _cuts(rows, n, [f"x{j}" for j in which], RANGE_ROWS)))
    groups, ranges = len(which) * (len(slabs) + 1), sum(len(c) + 1 for c in cuts.values())
    target = 1 + max(which)         # the target's ranks of feature j are those of number j + target

    def place(*cols):
        y = cols[-1]
        parts = _split(np.searchsorted(slabs, y))
        return [_block(VALUES, j, part, y[r], x[r]) for j, x in zip(which, cols) for part, r in parts]

    def inside(table):
        cells = _cells(table, VALUES)
        f, at = cells[0]["f"], cells[0]["at"]
        y, x = _joined(cells, "a", float), _joined(cells, "b", float)
        by = np.lexsort((x, y))
        x, y = x[by], y[by]
        own = Plane(x, y).nearest(k)
        r = own[:, k - 1]
        far = np.minimum(y - (slabs[at - 1] if at else -np.inf), (slabs[at] if at < len(slabs) else np.inf) - y)
        open_ = r >= far
        done, left = np.flatnonzero(~open_), np.flatnonzero(open_)
        out = [_block(VALUES, f, at, y, x)]
        lo, hi = _ends(y[done], r[done])
        out.append(_block(SUMS, f, at, n=len(done), d=_psi_sum(np.searchsorted(y, hi, "left") - np.searchsorted(y, lo, "right"))))
        out += [_block(VALUES, f + target, part, x[v]) for part, v in _split(np.searchsorted(cuts[f], x))]
        out += _ends_out(f + target, cuts[f], at, done, *_ends(x[done], r[done]))
        if len(left):
            out.append(_block(OPEN, f, at, left.astype(np.int32), np.stack([x[left], y[left]]), own[left]))
            wide = _wider(r[left], np.maximum(np.abs(x[left]), np.abs(y[left])))
            first, last = np.searchsorted(slabs, y[left] - wide), np.searchsorted(slabs, y[left] + wide, "right")
            for t in range(int(first.min()), int(last.max()) + 1):
                q = left[(first <= t) & (t <= last)]
                if t != at and len(q):
                    out.append(_block(ASKED, f, t, q.astype(np.int32), np.stack([x[q], y[q], r[q]]), origin=at))
        return _blocks_out(out)
    found = kept(_by_range(_packed(rows, [*(f"x{j}" for j in which), "y"], place), groups).applyInArrow(inside, BLOCKS))
    kind, mine = F.col("kind"), F.col("f") < target
    in_target = _sums(found)
    plane = found.where((kind == VALUES) & mine)
    ends = found.where(kind == ENDS)
    asked = found.where(kind == ASKED)
    opened = found.where(kind == OPEN)
    if opened.limit(1).count():
        def answer(table):
            cells, out = _cells(table, ASKED), []
            points = _cells(table, VALUES)
            if cells and points:
                p = Plane(np.frombuffer(points[0]["b"]), np.frombuffer(points[0]["a"]))
                for r in cells:
                    x, y, reach = np.frombuffer(r["b"]).reshape(3, -1)
                    out.append((ASKED, r["f"], r["origin"], r["at"], 0, 0.0, r["a"], p.within(x, y, reach, k).tobytes(), b""))
            return _blocks_out(out)
        answers = _by_range(plane.unionByName(asked), groups).applyInArrow(answer, BLOCKS)

        def merge(table):
            mine = _cells(table, OPEN)
            if not mine:
                return _blocks_out([])
            f, at = mine[0]["f"], mine[0]["at"]
            who, (x, y) = _joined(mine, "a", np.int32), _joined(mine, "b", float).reshape(2, -1)
            near = _joined(mine, "c", float).reshape(-1, k).copy()
            for r in _cells(table, ASKED):
                rows_ = np.searchsorted(who, np.frombuffer(r["a"], np.int32))
                near[rows_] = np.sort(np.concatenate([near[rows_], np.frombuffer(r["b"]).reshape(-1, k)], axis=1), axis=1)[:, :k]
            d = near[:, k - 1]
            return _blocks_out([*_ends_out(f, slabs, at, who, *_ends(y, d)),
                                *_ends_out(f + target, cuts[f], at, who, *_ends(x, d))])
        late = kept(_by_range(opened.unionByName(answers), groups).applyInArrow(merge, BLOCKS))
        late_ends = late.where(kind == ENDS)
        ranks = kept(_ranks(plane.unionByName(late_ends.where(mine)), groups))
        sizes = ranks.where(kind == VALUES).select("f", "at", "n").collect()
        in_target = _add(in_target, _counted(ranks.where(kind == RANKS), groups, _before(sizes)))
        ends = ends.unionByName(late_ends.where(~mine))
    ranks = kept(_ranks(found.where((kind == VALUES) & ~mine).unionByName(ends), ranges))
    sizes = ranks.where(kind == VALUES).select("f", "at", "n").collect()
    in_feature = _counted(ranks.where(kind == RANKS), groups, _before(sizes))
    base = float(digamma(np.array([n]))[0] + digamma(np.array([k]))[0])
    return {j: max(0.0, base - (in_feature[j + target][1] + in_target[j][1]) / n) for j in which}


def neighbour_information(df: DataFrame, features: list[str], target: str, discrete_target: bool, digits: int = 6,
                          fill: dict[str, float] | None = None, k: int = K, unit_rows: int = UNIT_ROWS) -> dict[str, float]:
    """feature -> mutual information in nats, not below 0; features of an empty table score 0.

    Rows of a class of their own take no part. Missing and infinite features
    take ``fill``.
    """
    rows = scaled_rows(df, features, target, discrete_target, fill)
    n = rows.count()
    if discrete_target:
        terms, labels = _class_terms(rows, k), _class_codes(rows, n)
    else:
        slabs = _cuts(rows, n, ["y"], unit_rows)[0] if n else np.zeros(0)
    at_once = min(GROUP_FEATURES, max(1, GROUP_ROWS // max(1, n)))
    found: dict[int, float] = {}
    kept = _Kept()
    for lo in range(0, len(features), at_once):
        which = list(range(lo, min(lo + at_once, len(features))))
        try:
            found.update(_class_scores(kept, rows, n, which, k, terms, labels) if discrete_target
                         else _number_scores(kept, rows, n, which, k, slabs))
        finally:
            kept.free()
    return {c: round(found.get(j, 0.0), digits) for j, c in enumerate(features)}
