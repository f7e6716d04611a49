"""Exact dedup, SimHash and suffix dedup against brute force."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from llm.brute import brute_components

from tabloom.llm import simhash, suffix_dedup
from tabloom.llm.bk_tree import Forest, build
from tabloom.llm.components import components
from tabloom.llm.exact_dedup import exact_dedup
from tabloom.llm.simhash import fingerprint, keep_one, shard_masks, simhash_components
from tabloom.llm.suffix_dedup import radix_groups, remove_repeats, runs


def brute_exact(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    out = []
    for d, t, *_ in rows:
        g = groups[t or ""]
        keep = max((x for x in g if x is not None), default=None)
        out.append((d, keep, len(g), d == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("block,bits", [(4096, 64), (64, 64), (16, 3)])
def test_exact_dedup(docs, rows, block, bits):
    if bits == 3:
        docs, rows = docs.filter("length(text) < 5000 or text is null"), [r for r in rows if len(r[1] or "") < 5000]
    got = exact_dedup(docs, block_bytes=block, hash_bits=bits).collect()
    assert Counter(map(tuple, got)) == brute_exact(rows)


def test_exact_dedup_edges(clashing, rows, empty):
    assert Counter(map(tuple, exact_dedup(clashing).collect())) == brute_exact(rows)
    assert exact_dedup(empty).count() == 0


@pytest.mark.parametrize("tree_nodes", [4096, 3])
def test_simhash(docs, rows, tree_nodes):
    fps, comp = brute_components(rows)
    want = Counter((r[0], f, c) for r, f, c in zip(rows, fps, comp))
    got = simhash_components(docs, tree_nodes=tree_nodes).collect()
    assert Counter((r.id, r.fp & (2 ** 64 - 1), r.component_id) for r in got) == want


def test_simhash_keeps_one(docs, clashing, rows, empty):
    _, comp = brute_components(rows)
    want = sorted({r[0] for r, c in zip(rows, comp) if r[0] is not None and r[0] == c})
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == want
    assert keep_one(clashing).columns == clashing.columns
    assert simhash_components(empty).count() == 0 and keep_one(empty).count() == 0


def test_simhash_keeps_unlike_rows_of_one_id(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta", "one two three four five six seven", "red green blue black white grey")
    rows = [(1, a, "x"), (1, b, "x"), (2, c, "x"), (3, a, "x"), (None, b, "x"), (None, "only here and nowhere else", "x"),
            (None, "only here and nowhere else", "y"), (4, c, "x"), (2, c, "z"), (9, None, "x"), (8, "", "x")]
    got = keep_one(spark.createDataFrame(rows, "doc_id long, text string, sha string"))
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(
        [(1, a), (1, b), (2, c), (None, "only here and nowhere else"), (8, "")])


def test_trees_are_broadcast_by_their_exploded_size(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(simhash, "bounded", lambda df, n, size: seen.append(n * size) or df)
    fps = [(int(x),) for x in range(40)]        # one crowded shard, several trees
    trees = simhash.shard_trees(spark.createDataFrame(fps, "fp long"), 4, 8).cache()
    simhash.walk_trees(trees, 4)
    rows = trees.collect()
    assert any(r.n_trees > 1 for r in rows)
    assert seen == [sum((160 + 16 * len(r.fps)) * (r.n_trees - r.tree) for r in rows)]


def test_fingerprint_details():
    assert fingerprint(None) == 0 and fingerprint(b" \n ") == 0
    assert fingerprint(b"One TWO") == xxhash.xxh64_intdigest(b"one two", 42)
    assert len(shard_masks(4)) == 15


def test_bk_trees_follow_all_links():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2 ** 63, 4, dtype=np.uint64)
    groups = [sorted({int(b) ^ sum(1 << int(i) for i in set(rng.integers(0, 64, rng.integers(0, 7))))
                      for _ in range(30)}) for b in base]
    flat = np.array([x for g in groups for x in g], np.uint64)
    at = np.r_[0, np.cumsum([len(g) for g in groups])]
    fps, parents, edges = build(flat, at)
    for k in range(len(fps)):       # edge = integer distance to the parent
        if parents[k] >= 0:
            p = parents[k] + at[np.searchsorted(at, k, side="right") - 1]
            assert edges[k] == bin(int(fps[k]) ^ int(fps[p])).count("1")
    q, v = Forest(fps, parents, edges, at).within(flat, np.repeat(np.arange(4), np.diff(at)), 4)
    want = {(a, b) for g in groups for a in g for b in g if bin(a ^ b).count("1") <= 4}
    assert set(zip(flat[q].tolist(), fps[v].tolist())) == want


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 3), (7, 8), (5, 5)] + [(100 + k, 101 + k) for k in range(60)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    want = {1: 1, 2: 1, 3: 1, 9: 1, 7: 7, 8: 7} | {100 + k: 100 for k in range(61)}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_repeats(rows, depth):
    big = 2 ** 63 - 1
    first = {}
    texts = [((r[0] if r[0] is not None else big), r[0], (r[1] or "").encode()) for r in rows]
    for d, _, t in texts:
        for i in range(len(t) - depth + 1):
            s = t[i:i + depth]
            first[s] = min(first.get(s, big), d)
    out = []
    for d, given, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - depth + 1):
            if first[t[i:i + depth]] < d:
                gone[i:i + depth] = b"\1" * depth
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((given, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def test_suffix_dedup(docs, rows):
    got = remove_repeats(docs).select("id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == brute_repeats(rows, 50)


def test_suffix_dedup_periodic_and_edges(spark, clashing, empty, rows):
    more = [(1, "ab" * 200, None, None, 0), (2, "x" + "ab" * 90, None, None, 0), (3, "a" * 49, None, None, 0),
            (4, "a" * 50, None, None, 0), (5, "a" * 500, None, None, 0), (6, "zz" + "ab" * 30 + "a" * 60, None, None, 0)]
    df = spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long")
    cols = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert Counter(map(tuple, remove_repeats(df).select(*cols).collect())) == brute_repeats(more, 50)
    assert Counter(map(tuple, remove_repeats(clashing).select(*cols).collect())) == brute_repeats(rows, 50)
    assert remove_repeats(empty).count() == 0


def test_suffix_dedup_heavy_anchors(spark, docs, rows):
    cols = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    for least in (2, 15):
        got = remove_repeats(docs, heavy_runs=least, sample=1).select(*cols).collect()
        assert Counter(map(tuple, got)) == brute_repeats(rows, 50)
    more = [(1, "ab" * 200), (2, "x" + "ab" * 90), (4, "a" * 50), (5, "a" * 500), (6, "zz" + "ab" * 30 + "a" * 60)]
    df = spark.createDataFrame(more, "doc_id long, text string")
    got = remove_repeats(df, heavy_runs=2, sample=1).select(*cols).collect()
    assert Counter(map(tuple, got)) == brute_repeats(more, 50)


def test_suffix_dedup_deals_a_common_line(spark):
    rng = np.random.default_rng(3)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)
    line = "All rights reserved by the owner."
    text = [bytes(rng.choice(letters, 60)).decode() + line + bytes(rng.choice(letters, 60)).decode() for _ in range(1500)]
    docs = spark.createDataFrame(list(enumerate(text)), "doc_id long, text string")
    src = docs.selectExpr("cast(text as binary) text", "doc_id id", "doc_id name", "xxhash64(text) key")
    heavy, inner, more = suffix_dedup._heavy_anchors(src.select("text", "key"), 8, 50, 24, 200, 4)
    shared = suffix_dedup._shared_anchors(src.select("text", "key"), 8, 50, 24, heavy)
    held = src.join(shared, "key").select("text", "id", "name", "names")
    size = Counter()
    for r in suffix_dedup._packed_runs(held, 8, 50, 24, heavy, 8, inner).filter("part >= 0").collect():
        size[r["part"]] += len(r["data"])
    assert len(heavy) and max(size.values()) < 0.25 * sum(size.values())
    cols = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    rows = list(enumerate(text))
    got = remove_repeats(docs, heavy_runs=200, sample=4).select(*cols).collect()
    assert Counter(map(tuple, got)) == brute_repeats(rows, 50)


def test_cores_cover_every_window_once():
    rng = np.random.default_rng(1)
    for size, off in ((76, 26), (50, 0), (50, 26), (60, 12), (53, 5)):
        run = bytes(rng.integers(97, 123, size, dtype=np.uint8))
        every = [c for _, _, c in suffix_dedup.cores(run, off, 24, 50)]
        for heavy in (set(), set(every), set(every[::2]), set(every[:1])):
            found = list(suffix_dedup.cores(run, off, 24, 50, heavy))
            assert sorted(k for a, b, _ in found for k in range(a, b + 1)) == list(range(size - 49))
            assert not heavy & {c for _, _, c in found} or any(a == b for a, b, _ in found)
        if size == 76:      # two stretches unless a core is heavy, single windows if all are
            assert len(list(suffix_dedup.cores(run, off, 24, 50, set()))) == 2
            assert len(list(suffix_dedup.cores(run, off, 24, 50, set(every)))) == 27


def test_runs_and_radix_groups():
    rng = np.random.default_rng(5)
    text = bytes(rng.integers(97, 99, 600, dtype=np.uint8)) * 2
    data = np.frombuffer(text, np.uint8)
    first, last, anchor, _ = runs(data, np.array([0, 500, len(data)]), 50, 24)
    starts = [s for a, b in zip(first, last) for s in range(a, b + 1)]
    assert starts == [*range(451), *range(500, len(data) - 49)]
    assert all(b <= c and c + 24 <= a + 50 for a, b, c in zip(first, last, anchor))
    at = np.arange(len(data) - 49)
    label = radix_groups(data, at, 50)
    groups = defaultdict(list)
    for s in at:
        groups[text[s:s + 50]].append(s)
    for members in groups.values():
        found = {int(label[s]) for s in members}
        assert found == {-1} if len(members) == 1 else len(found) == 1 and found != {-1}


def test_suffix_spans_rows_follow_the_texts(spark):
    """The passages of a text meet in many parts; they come back as one row per text, packed on the way."""
    rng = np.random.default_rng(8)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)
    passages = [bytes(rng.choice(letters, 80)).decode() for _ in range(30)]
    rows = [(k, "|".join([passages[j] for j in rng.permutation(30)[:20]] + [f"own {k}"])) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    src = docs.selectExpr("cast(text as binary) text", "doc_id id", "doc_id name", "xxhash64(text) key")
    none = np.zeros(0, np.int64)
    shared = suffix_dedup._shared_anchors(src.select("text", "key"), 16, 50, 24, none)
    assert shared.count() == shared.select("key").distinct().count() == 400
    held = src.join(shared, "key").select("text", "id", "name", "names").cache()
    packed = suffix_dedup._packed_runs(held, 16, 50, 24, none, 1)
    met = suffix_dedup._by_part(packed, 16, lambda part, rows: suffix_dedup._repeats(rows, 50, 24) if part >= 0 else (
        none, [none, none]), 2)
    assert met.count() <= 16 * 16
    spans = suffix_dedup._suffix_spans(held, 16, 50, 24, none, 1, frozenset())
    assert spans.count() == spans.select("name").distinct().count() >= 390
    cols = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert Counter(map(tuple, remove_repeats(docs).select(*cols).collect())) == brute_repeats(rows, 50)


def test_merged_spans():
    name, (start, end) = suffix_dedup.merged(np.array([7, 5, 5, 5, 7, 5]), [np.array([0, 90, 0, 40, 10, 5]),
                                                                          np.array([9, 99, 60, 50, 20, 90])])
    assert list(zip(name, start, end)) == [(5, 0, 99), (7, 0, 9), (7, 10, 20)]
