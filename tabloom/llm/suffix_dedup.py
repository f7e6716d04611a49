"""Removal of repeated byte strings by depth-limited radix sorting of suffixes.

A byte goes if it lies in a string of ``depth`` bytes that also starts in a
document with a smaller id. Only suffixes that can repeat are sorted:

1. Equal texts are one text, that of the smallest id; the others lose all.
2. Each window of ``depth`` bytes is dealt by its anchor, the byte gram inside
   it with the smallest hash. Equal windows have equal anchors, and a run of
   windows shares one, so there is an anchor for about every 14 bytes. The
   anchors' hashes are counted over the whole corpus; windows whose anchor
   occurs in one text only cannot repeat and go no further.
3. The runs of the other windows meet by anchor. Runs equal in whole are
   ordered once. The rest are sorted by most-significant-digit passes of eight
   bytes through ``depth`` bytes; a suffix that is alone drops out, and the
   groups left after the last pass are exactly the repeated windows.

An anchor of very many runs, such as a line in a third of the documents, is
not held whole: heavy anchors are taken as shared without meeting, and their
runs are dealt by longer cores. A window holds its anchor and as many more
bytes; at least half of these lie on one side, so a run falls into the windows
that hold the anchor with that half on its right and the rest, which hold it
with that half on their left, and each part meets by its own core. A core that
is heavy in turn is extended again, down to single windows. Which anchors and
cores are heavy is counted in a sample of the texts; equal windows always take
the same path, so a miss changes where they meet and nothing else.

Within a task, equal runs are settled at once and only that of the smallest
id goes on, so a passage that any number of documents share gives one record
per task slice. Records travel packed, many to a row.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.shared import stage, text_slices

DEPTH = 50
GRAM = 24                   # bytes of an anchor
PIECE = 1 << 20             # window starts of a long text handled at once
SLICE = 2 << 20             # text bytes handled at once
PART_BYTES = 32 << 20       # text bytes per part of the anchor and suffix shuffles
HEAVY_RUNS = 1 << 15        # runs of an anchor or core from which it is dealt by longer cores
SAMPLE = 64                 # one text in this many is counted to find those anchors
NO_ID = (1 << 63) - 1       # a null id counts as the largest


def pieces(texts: list, depth: int):
    """(text number, offset, bytes): pieces whose window starts are disjoint and complete."""
    for k, t in enumerate(texts):
        for at in range(0, len(t) - depth + 1, PIECE):
            yield k, at, t[at:at + PIECE + depth - 1]


def _gram_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all n-byte grams, from those of gram halves."""
    with np.errstate(over="ignore"):
        sizes = {1: (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)}
        step = 1
        while step * 2 <= n:
            h = sizes[step]
            h = (h[:-step] * np.uint64(0xC2B2AE3D27D4EB4F) + h[step:]) * np.uint64(0x165667B19E3779F9)
            h ^= h >> np.uint64(32)
            sizes[step * 2] = h
            step *= 2
        out = None
        at = 0
        for size in sorted(sizes, reverse=True):
            if n - at >= size:
                part = sizes[size][at:at + len(data) - n + 1]
                out = part.copy() if out is None else out * np.uint64(0xFF51AFD7ED558CCD) + part
                out ^= out >> np.uint64(29)
                at += size
        return out * np.uint64(0xC4CEB9FE1A85EC53)


def runs(data: np.ndarray, bounds: np.ndarray, depth: int, gram: int):
    """Runs of windows with one anchor: (first start, last start, anchor place, anchor hash).

    ``bounds`` are the offsets of the pieces in ``data``; windows stay inside a piece.
    """
    width = depth - gram + 1
    h = _gram_hashes(data, gram)
    mask = np.uint64((1 << max(1, int(len(h)).bit_length())) - 1)
    # The smallest hash (upper bits), of ties the leftmost place (lower bits), over each window.
    low = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
    step = 1
    while step * 2 <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if width > step:
        low = np.minimum(low[:len(low) - (width - step)], low[width - step:])
    valid = np.ones(len(low), bool)
    for end in bounds[1:-1]:
        valid[max(0, end - depth + 1):end] = False
    start = np.flatnonzero(valid)
    anchor = (low[start] & mask).astype(np.int64)
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:] - 1, len(start) - 1]
    return start[first], start[last], anchor[first], h[anchor[first]]


def _slices(batch, text_at: int, depth: int, gram: int):
    """Per slice of a batch: row offset, row count, bytes, runs, and the piece table."""
    texts = batch.column(text_at)
    for lo, n in text_slices(texts, SLICE):
        part = list(pieces(texts.slice(lo, n).to_pylist(), depth))
        # A very long text is handled piece by piece.
        while part:
            take, size = 0, 0
            while take < len(part) and (not take or size + len(part[take][2]) <= SLICE):
                size += len(part[take][2])
                take += 1
            now, part = part[:take], part[take:]
            data = b"".join(p for _, _, p in now)
            bounds = np.cumsum([0, *(len(p) for _, _, p in now)])
            found = runs(np.frombuffer(data, np.uint8), bounds, depth, gram)
            piece = np.searchsorted(bounds, found[0], side="right") - 1
            rows = np.array([k for k, _, _ in now], np.int64)[piece] + lo
            place = found[0] - bounds[piece] + np.array([at for _, at, _ in now], np.int64)[piece]
            yield data, found, rows, place


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


def _name(h: np.ndarray, parts: int) -> np.ndarray:
    """Part and lower half of a hash: what the filter tells anchors apart by."""
    return (_part(h, parts) << 32) | (h & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _core_name(core: bytes) -> int:
    from xxhash import xxh64_intdigest
    return xxh64_intdigest(core) >> 1       # fits a long


def cores(run: bytes, off: int, gram: int, depth: int, heavy=None):
    """(first window, last window, name of the core) of the stretches that a heavy run falls into.

    With ``heavy`` (names) a stretch is split on while its core is heavy; the
    core of a single window is the window. Without, every stretch on the way
    down is given, but for single windows.
    """
    left = [(0, len(run) - depth, off, off + gram)]
    while left:
        lo, hi, a, b = left.pop()
        more = (depth - (b - a) + 1) // 2
        cut = max(lo, b + more - depth)     # from here on a window has ``more`` bytes right of the core
        for first, last, c, d in ((cut, hi, a, b + more), (lo, min(hi, cut - 1), a - more, b)):
            if first > last:
                continue
            if d - c == depth:
                if heavy is not None:
                    yield first, last, _core_name(run[c:d])
                continue
            name = _core_name(run[c:d])
            if heavy is None or name not in heavy:
                yield first, last, name
            if heavy is None or name in heavy:
                left.append((first, last, c, d))


def _counted(rows: DataFrame, least: int, share: int) -> DataFrame:
    """Names of (key, name, n) that come about ``least`` times or more in all, with the count in the sample."""
    return (rows.groupBy("key", "name").agg(F.max("n").alias("n")).groupBy("name").agg(F.sum("n").alias("n"))
            .filter(F.col("n") * share >= least))


def _heavy_anchors(texts: DataFrame, parts: int, depth: int, gram: int, least: int, share: int):
    """(sorted names of the heavy anchors, names of the heavy cores, parts for the runs of both).

    Counted over one distinct text in ``share``; there are at most as many as
    there are runs over ``least``.
    """
    sample = texts.filter(F.pmod("key", F.lit(share)) == 0)

    def rows(keys, names):
        import pyarrow as pa
        both, n = np.unique(np.stack([keys, names], 1), axis=0, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(n.astype(np.int64))],
                                          names=["key", "name", "n"])

    def count(batches):
        for batch in batches:
            keys = batch.column(1).to_numpy()
            for _, (_, _, _, h), row, _ in _slices(batch, 0, depth, gram):
                yield rows(keys[row], _name(h, parts))
    found = _counted(sample.mapInArrow(count, "key long, name long, n long"), least, share).collect()
    heavy = np.array(sorted(r["name"] for r in found), np.int64)
    more = max(1, -(-sum(r["n"] for r in found) * share * 4 * depth // PART_BYTES))
    if not len(heavy):
        return heavy, frozenset(), more

    def count_cores(batches):
        for batch in batches:
            keys = batch.column(1).to_numpy()
            for data, (first, last, anchor, h), row, _ in _slices(batch, 0, depth, gram):
                at, names = [], []
                for r in np.flatnonzero(np.isin(_name(h, parts), heavy)).tolist():
                    run = data[first[r]:last[r] + depth]
                    own = [c for _, _, c in cores(run, int(anchor[r] - first[r]), gram, depth)]
                    at += [keys[row[r]]] * len(own)
                    names += own
                if at:
                    yield rows(np.array(at, np.int64), np.array(names, np.int64))
    inner = _counted(sample.mapInArrow(count_cores, "key long, name long, n long"), least, share)
    return heavy, frozenset(r["name"] for r in inner.collect()), more


def _shared_anchors(texts: DataFrame, parts: int, depth: int, gram: int, heavy: np.ndarray) -> DataFrame:
    """(key, names): per text (key = its 64-bit hash) the anchors that occur in another text too."""
    def note(batches):
        import pyarrow as pa
        for batch in batches:
            keys = batch.column(1).to_numpy()
            for _, (_, _, _, h), rows, _ in _slices(batch, 0, depth, gram):
                both = np.unique(np.stack([_name(h, parts), keys[rows]], 1), axis=0)
                known = np.isin(both[:, 0], heavy)
                sure, both = both[known], both[~known]
                part = both[:, 0] >> 32
                cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
                ends = np.r_[cut[1:], len(part)][:len(cut)]
                out = [[], [], [], []]
                to = sure[:, 1] % parts         # heavy anchors need not meet: by text, under negative parts
                for q in np.unique(to):
                    out[0].append(-1 - int(q))
                    out[1].append(sure[to == q, 0].tobytes())
                    out[2].append(sure[to == q, 1].tobytes())
                    out[3].append(b"")
                for a, b in zip(cut, ends):
                    by = np.argsort(both[a:b, 1], kind="stable")
                    names, docs = both[a:b][by].T
                    own, count = np.unique(docs, return_counts=True)
                    out[0].append(int(part[a]))
                    out[1].append(names.astype(np.uint32).tobytes())
                    out[2].append(own.tobytes())
                    out[3].append(count.astype(np.uint32).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int32()), *(pa.array(x, pa.binary()) for x in out[1:])],
                    names=["part", "names", "keys", "counts"])

    def meet(part, rows):
        if part < 0:
            names, keys = (np.concatenate([np.frombuffer(r[c], np.int64) for r in rows]) for c in (0, 1))
            return keys, [names]
        names = np.concatenate([np.frombuffer(r[0], np.uint32) for r in rows])
        keys = np.concatenate([np.repeat(np.frombuffer(r[1], np.int64), np.frombuffer(r[2], np.uint32))
                               for r in rows])
        order = np.argsort(names, kind="stable")
        names, keys = names[order], keys[order]
        cut = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
        twice = np.minimum.reduceat(keys, cut) != np.maximum.reduceat(keys, cut)
        held = np.repeat(twice, np.diff(np.r_[cut, len(names)]))
        return keys[held], [names[held].astype(np.int64) | (part << 32)]

    def distinct(keys, values):
        both = np.unique(np.stack([keys, values[0]], 1), axis=0)
        return both[:, 0], [both[:, 1]]

    rows = texts.mapInArrow(note, "part int, names binary, keys binary, counts binary")
    return _by_key(_by_part(rows, parts, meet, 1), parts, distinct, "key long, names array<bigint>")


def _grouped(batches):
    """(number, rows) of rows that come sorted by the number in their first column."""
    now, held = None, []
    for batch in batches:
        for k, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and k != now:
                yield now, held
                held = []
            now = k
            held.append(row)
    if held:
        yield now, held


def _by_part(rows: DataFrame, parts: int, meet, n_values: int) -> DataFrame:
    """Bring the packed rows of each part together and run ``meet(part, rows)`` on one part at a time.

    ``meet`` returns a key array and ``n_values`` value arrays, which go on
    packed: one row per part and bucket of keys, however many keys there are.
    """
    names = ["bucket", "keys", *(f"v{k}" for k in range(n_values))]

    def run(batches):
        import pyarrow as pa
        for part, held in _grouped(batches):
            keys, values = meet(part, held)
            to = _part(keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), parts)
            order = np.argsort(to, kind="stable")
            to, columns = to[order], [c[order] for c in (keys, *values)]
            cut = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else np.zeros(0, np.int64)
            ends = np.r_[cut[1:], len(to)][:len(cut)]
            if len(cut):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to[cut].astype(np.int32)),
                     *(pa.array([c[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary()) for c in columns)],
                    names=names)
    schema = "bucket int, " + ", ".join(f"{c} binary" for c in names[1:])
    return rows.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(run, schema)


def _by_key(rows: DataFrame, buckets: int, settle, schema: str) -> DataFrame:
    """One row per key, with the values as lists, of the packed rows of ``_by_part``.

    ``settle`` takes all keys and values of a bucket and returns those that
    stay, sorted by key.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        import pyarrow as pa
        for _, held in _grouped(batches):
            keys, *values = (np.concatenate([np.frombuffer(x, np.int64) for x in c]) for c in zip(*held))
            keys, values = settle(keys, values)
            cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            at = pa.array(np.r_[cut, len(keys)].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[cut]), *(pa.ListArray.from_arrays(at, pa.array(v)) for v in values)], names=names)
    return rows.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def radix_groups(data: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """Labels of the suffixes at ``starts``: equal, and not negative, exactly if they agree on ``depth`` bytes.

    Most-significant-digit passes of eight bytes; a suffix alone in its group
    gets label -1 and drops out.
    """
    out = np.full(len(starts), -1, np.int64)
    live, label = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    for at in range(0, depth, 8):
        digit = np.zeros(len(live), np.uint64)
        for j in range(at, min(at + 8, depth)):
            digit = (digit << np.uint64(8)) | data[starts[live] + j].astype(np.uint64)
        order = np.lexsort((digit, label))
        live, label, digit = live[order], label[order], digit[order]
        new = np.r_[True, (label[1:] != label[:-1]) | (digit[1:] != digit[:-1])] if len(live) else np.zeros(0, bool)
        label = np.cumsum(new) - 1
        many = np.bincount(label, minlength=1)[label] > 1
        live, label = live[many], label[many]
    out[live] = label
    return out


def _repeats(rows, depth: int, gram: int):
    """(name, start, end) of the windows of a part that start in a smaller id too.

    ``rows`` are packed runs: ids, names, places, anchor offsets, lengths, bytes.
    """
    variants: dict[tuple[int, bytes], int] = {}
    low: list[int] = []                     # smallest id of a variant
    which, ids, names, places = [], [], [], []
    for i, n, p, o, size, data in rows:
        i, n, p = (np.frombuffer(x, np.int64) for x in (i, n, p))
        at = 0
        for own, off, length in zip(i.tolist(), o, np.frombuffer(size, np.uint32).tolist()):
            k = variants.setdefault((off, data[at:at + length]), len(low))
            at += length
            if k == len(low):
                low.append(own)
            elif own < low[k]:
                low[k] = own
            which.append(k)
        ids.append(i)
        names.append(n)
        places.append(p)
    ids, names, places = map(np.concatenate, (ids, names, places))
    which, low = np.array(which, np.int64), np.array(low, np.int64)
    runs_ = list(variants)
    length = np.array([len(d) for _, d in runs_], np.int64)

    # Windows of runs whose anchor comes in more than one form are sorted.
    form: dict[bytes, int] = {}
    group = np.array([form.setdefault(d[o:o + gram], len(form)) for o, d in runs_], np.int64)
    mixed = np.flatnonzero(np.bincount(group)[group] > 1)
    data = np.frombuffer(b"".join(runs_[k][1] for k in mixed), np.uint8)
    base = np.cumsum(np.r_[0, length[mixed]])[:-1]
    n = length[mixed] - depth + 1
    of = np.repeat(np.arange(len(mixed)), n)
    inner = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    label = radix_groups(data, base[of] + inner, depth)
    owner = low[mixed][of]
    best = np.full(int(label.max(initial=-1)) + 1, NO_ID, np.int64)
    np.minimum.at(best, label[label >= 0], owner[label >= 0])
    smaller = np.zeros(len(of), bool)
    smaller[label >= 0] = best[label[label >= 0]] < owner[label >= 0]

    whole = np.flatnonzero(ids > low[which])          # an equal run has a smaller id
    out = [(names[whole], places[whole], places[whole] + length[which[whole]])]
    # Of the smallest id's own runs, the stretches of windows found in a smaller id elsewhere.
    edge = np.flatnonzero(smaller & ~(np.r_[False, smaller[:-1]] & (inner > 0)))
    stop = np.flatnonzero(smaller & ~np.r_[smaller[1:] & (inner[1:] > 0), False]) if len(of) else edge
    by = np.full(len(low), -1, np.int64)
    by[mixed] = np.arange(len(mixed))
    cut = np.searchsorted(of[edge], np.arange(len(mixed) + 1))
    own = np.flatnonzero((ids == low[which]) & (by[which] >= 0))
    m = by[which[own]]
    count = cut[m + 1] - cut[m]
    rec = np.repeat(own, count)
    k = np.arange(len(rec)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(cut[m], count)
    out.append((names[rec], places[rec] + inner[edge[k]], places[rec] + inner[stop[k]] + depth))
    name, start, end = (np.concatenate(x) for x in zip(*out))
    return name, [start, end]


def _packed_runs(texts: DataFrame, parts: int, depth: int, gram: int, heavy: np.ndarray, more: int,
                 heavy_cores: frozenset = frozenset()) -> DataFrame:
    """Packed runs by part; those of ``heavy`` anchors by their ``cores``, over ``more`` parts of their own.

    ``texts`` has text, id, name and the names of shared anchors.
    """
    def send(batches):
        import pyarrow as pa
        for batch in batches:
            ids, names = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            lists = batch.column(3)
            at = lists.offsets.to_numpy().astype(np.int64)
            salt = np.repeat(np.arange(len(ids)), np.diff(at)) << 40
            marked = np.sort(lists.values.to_numpy()[at[0]:at[-1]] ^ salt)
            for data, (first, last, anchor, h), rows, place in _slices(batch, 0, depth, gram):
                want = _name(h, parts) ^ (rows << 40)
                k = np.minimum(np.searchsorted(marked, want), max(len(marked) - 1, 0))
                hit = np.flatnonzero(marked[k] == want) if len(marked) else np.zeros(0, np.int64)
                same: dict[tuple[int, bytes], list[int]] = {}
                for r, a, b, c in zip(hit.tolist(), first[hit].tolist(), last[hit].tolist(), anchor[hit].tolist()):
                    same.setdefault((c - a, data[a:b + depth]), []).append(r)
                by_part: dict[int, list] = {}
                part = _part(h, parts)
                wide = np.isin(_name(h, parts), heavy)
                dealt: dict[tuple[int, int, bytes], list] = {}
                gone = []
                for (off, run), records in same.items():
                    least = min(ids[rows[r]] for r in records)
                    for r in records:
                        row = rows[r]
                        if ids[row] > least:
                            gone.append((names[row], place[r], place[r] + len(run)))
                        elif wide[r]:
                            for lo, hi, core in cores(run, off, gram, depth, heavy_cores):
                                dealt.setdefault((core, off - lo, run[lo:hi + depth]), []).append(
                                    (ids[row], names[row], place[r] + lo))
                        else:
                            by_part.setdefault(int(part[r]), []).append((ids[row], names[row], place[r], off, run))
                for (core, shift, piece), records in dealt.items():
                    least = min(x[0] for x in records)
                    for x in records:
                        if x[0] > least:
                            gone.append((x[1], x[2], x[2] + len(piece)))
                        else:
                            by_part.setdefault(parts + core % more, []).append((*x, shift, piece))
                out = [(p, *(np.array([x[c] for x in v], np.int64).tobytes() for c in range(3)),
                        bytes(x[3] for x in v), np.array([len(x[4]) for x in v], np.uint32).tobytes(),
                        b"".join(x[4] for x in v)) for p, v in by_part.items()]
                if gone:    # settled here: the spans travel as they are, under negative parts
                    out.append((-1 - int(gone[0][0]) % parts, b"", *(np.array([x[c] for x in gone], np.int64).tobytes() for c in (0, 1)),
                                b"", np.array([x[2] for x in gone], np.int64).tobytes(), b""))
                if out:
                    kinds = [pa.int32(), *[pa.binary()] * 6]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out), kinds)],
                        names=["part", "ids", "names", "places", "offsets", "lengths", "data"])

    return texts.mapInArrow(send, "part int, ids binary, names binary, places binary, offsets binary, "
                                  "lengths binary, data binary")


def _suffix_spans(texts: DataFrame, parts: int, depth: int, gram: int, heavy: np.ndarray, more: int,
                  heavy_cores: frozenset) -> DataFrame:
    """(name, starts, ends) of removals, one row per text; ``texts`` as for ``_packed_runs``."""
    def meet(part, rows):
        if part >= 0:
            return _repeats(rows, depth, gram)
        name, start, end = (np.concatenate([np.frombuffer(r[c], np.int64) for r in rows]) for c in (1, 2, 4))
        return name, [start, end]

    rows = _packed_runs(texts, parts, depth, gram, heavy, more, heavy_cores)
    met = _by_part(rows, parts + (more if len(heavy) else 0), meet, 2)
    return _by_key(met, parts, merged, "name long, starts array<bigint>, ends array<bigint>")


def merged(names: np.ndarray, spans: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(names, [starts, ends]) in order, those of a name that overlap or touch as one."""
    order = np.lexsort((spans[0], names))
    name, start, end = names[order], spans[0][order], spans[1][order]
    fresh = np.r_[True, name[1:] != name[:-1]]
    # The furthest end so far of a name: names count in the upper half, a text has less than 2^31 bytes.
    rank = (np.cumsum(fresh) - 1) << 32
    far = np.maximum.accumulate(rank + end) - rank
    first = np.flatnonzero(np.r_[True, fresh[1:] | (start[1:] > far[:-1])])
    return name[first], [start[first], far[np.r_[first[1:], len(name)] - 1]]


OUTCOME = "name long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start:bigint,end:bigint>>"


def _cut(rows: DataFrame, with_text: bool) -> DataFrame:
    """Apply the spans: ``rows`` has text, name, starts and ends (in order, apart)."""
    def run(batches):
        import pyarrow as pa
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        schema = pa.schema([("name", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                            ("kept_sha256", pa.string()), ("kept", pa.binary()), ("spans", pa.list_(span))])
        for batch in batches:
            out = []
            for text, name, starts, ends in zip(*(c.to_pylist() for c in batch.columns)):
                spans = list(zip(starts, ends))
                at, kept = 0, []
                for a, b in spans:
                    kept.append(text[at:a])
                    at = b
                kept = b"".join([*kept, text[at:]])
                out.append({"name": name, "n_removed": len(text) - len(kept), "n_spans": len(spans),
                            "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": kept if with_text else None,
                            "spans": [{"start": a, "end": b} for a, b in spans]})
            yield pa.RecordBatch.from_pylist(out, schema=schema)
    return rows.mapInArrow(run, OUTCOME)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH,
                   gram: int = GRAM, with_text: bool = False, heavy_runs: int = HEAVY_RUNS,
                   sample: int = SAMPLE) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256, spans (bytes), kept (if asked).

    A null text is empty; a text shorter than ``depth`` loses nothing. A null
    id counts as larger than any other; rows repeated with an id are one
    document, so they take nothing from each other. Spans overlap and are
    merged; strings are judged on the input, not on what is left.
    """
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    src = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"),
                      F.col(id_col).alias("given"), body.alias("text"))
    rows = stage(src.select("id", "given", F.sha2("text", 256).alias("sha"), F.xxhash64("text").alias("key"),
                            F.octet_length("text").cast("long").alias("n_bytes")), "suffix-rows")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    parts = max(1, -(-total // PART_BYTES), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = min(parts, max(1, total // (1 << 16)))
    reps = stage(rows.groupBy("sha").agg(F.min("id").alias("rep"), F.first("key").alias("key"))
                 .withColumn("name", F.monotonically_increasing_id()), "suffix-reps")

    keyed = src.select("text", F.xxhash64("text").alias("key"))
    heavy, heavy_cores, more = _heavy_anchors(keyed, parts, depth, gram, heavy_runs, sample)
    shared = _shared_anchors(keyed, parts, depth, gram, heavy)
    wanted = stage(reps.join(shared, "key").select("sha", F.col("rep").alias("id"), "name", "names"), "suffix-wanted")
    sha = F.sha2("text", 256)
    held = src.select("id", sha.alias("sha"), "text").join(wanted, ["id", "sha"]).select("text", "id", "name", "names")
    spans = stage(_suffix_spans(held, parts, depth, gram, heavy, more, heavy_cores), "suffix-spans")
    cut = stage(spans.join(reps, "name").select("sha", F.col("rep").alias("id"), "name", "starts", "ends"), "suffix-cut")
    outcome = stage(_cut(src.select("id", sha.alias("sha"), "text").join(cut, ["id", "sha"])
                         .select("text", "name", "starts", "ends"), with_text).dropDuplicates(["name"]), "suffix-outcome")

    known = stage(reps.join(outcome, "name", "left").drop("name", "key"), "suffix-known")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    copy = (F.col("id") > F.col("rep")) & (F.col("n_bytes") >= depth)
    out = rows.join(known, "sha").select(
        F.col("given").alias("id"), "n_bytes",
        F.when(copy, F.col("n_bytes")).when(F.col("id") > F.col("rep"), 0).otherwise(
            F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, 1).when(F.col("id") > F.col("rep"), 0).otherwise(
            F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit(b""), 256)).when(F.col("id") > F.col("rep"), F.col("sha")).otherwise(
            F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(copy, whole).when(F.col("id") > F.col("rep"), none).otherwise(
            F.coalesce("spans", none)).alias("spans"), *(["kept"] if with_text else []))
    return out


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
