"""SimHash near-dedup with BK-trees.

Every text gets a 64-bit fingerprint of its word shingles. The distinct
fingerprints are dealt to shards so that any two within the radius share one:
the 64 bits are cut into radius + 2 blocks, two fingerprints within the
radius agree on two blocks at least, and a shard is a pair of blocks with
their bits. In each shard BK-trees of bounded size are built, their children
keyed by the integer Hamming distance to the parent; the shard's fingerprints
walk its trees and follow only edges within the radius. The trees are
broadcast if their measured size is within the bound, else they and their
queries meet by a shuffle on the shard.

A walk returns one link per fingerprint to the smallest of the group it was
found in, never all pairs. Components of the links are computed by Spark.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.bk_tree import Forest, build, forest_labels
from tabloom.llm.components import components
from tabloom.llm.shared import bounded, map_texts, stage

SHINGLE_WORDS = 4
MAX_BITS = 4
TREE_NODES = 4096       # a larger shard is dealt to several trees
WALK_CELLS = 4 << 20    # queries x tree nodes walked at once
HASH_CHUNK = 1 << 16    # shingles whose bits are counted at once


def fingerprint(text: bytes | None, shingle: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash: bit i is set if it is set in over half of the shingles' XXH64 (seed 42).

    Words are separated by ASCII white space, A-Z is folded. A text of fewer
    words is one shingle; a text without words, or null, has fingerprint 0.
    """
    from xxhash import xxh64_intdigest
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(joined, 42)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[:len(words) - shingle + 1]
    end = end[shingle - 1:]
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(start), HASH_CHUNK):
        part = zip(start[lo:lo + HASH_CHUNK].tolist(), end[lo:lo + HASH_CHUNK].tolist())
        h = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in part], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(start), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = SHINGLE_WORDS) -> DataFrame:
    """(id, fp) per row; fp is the fingerprint as a signed long."""
    def make():
        return lambda texts: (np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64),)
    return map_texts(docs, text_col, [id_col], make, T.StructType([T.StructField("fp", T.LongType())])).select(
        F.col("row").getField(id_col).alias("id"), "res.fp")


def shard_masks(radius: int) -> list[int]:
    """Signed 64-bit masks: every pair of the radius + 2 blocks."""
    cuts = np.linspace(0, 64, radius + 3).round().astype(int)
    blocks = [((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in zip(cuts[:-1], cuts[1:])]
    masks = [x | y for x, y in combinations(blocks, 2)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


TREE = "shard int, bits long, tree int, n_trees int, fps array<long>, parents array<int>, edges array<int>"


def shard_trees(nodes: DataFrame, radius: int, tree_nodes: int = TREE_NODES) -> DataFrame:
    """BK-trees (columns of ``TREE``) of all shards that hold two fingerprints or more."""
    keys = F.array(*[F.struct(F.lit(k).alias("shard"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits"))
                     for k, m in enumerate(shard_masks(radius))])
    dealt = nodes.select("fp", F.explode(keys).alias("k")).select("k.shard", "k.bits", "fp")
    sizes = dealt.groupBy("shard", "bits").agg(F.count("*").alias("n")).filter("n > 1")
    members = dealt.join(sizes, ["shard", "bits"]).withColumn(
        "n_trees", F.ceil(F.col("n") / F.lit(tree_nodes)).cast("int"))
    groups = (members.withColumn("tree", F.pmod(F.xxhash64("fp"), F.col("n_trees")).cast("int"))
              .groupBy("shard", "bits", "tree", "n_trees").agg(F.array_sort(F.collect_list("fp")).alias("fps")))

    def grow(batches):
        import pyarrow as pa
        for b in batches:
            lists = b.column(4)
            at = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.values.to_numpy(zero_copy_only=False)[at[0]:at[-1]].view(np.uint64)
            fps, parents, edges = build(flat, at - at[0])
            offsets = pa.array((at - at[0]).astype(np.int32))
            as_list = lambda x, t: pa.ListArray.from_arrays(offsets, pa.array(x, t))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:4], as_list(fps.view(np.int64), pa.int64()), as_list(parents, pa.int32()),
                 as_list(edges, pa.int32())], names=[c.split()[0] for c in TREE.split(", ")])
    return groups.mapInArrow(grow, TREE)


def _walk_rows(tree_rows, query_rows, radius: int):
    """(fp, smallest fp of its group) links of rows of (tree arrays, query list)."""
    fps, parents, edges, at = tree_rows
    queries, q_at = query_rows
    forest = Forest(fps, parents, edges, at)
    tree_of = np.repeat(np.arange(len(q_at) - 1), np.diff(q_at))
    values, index = np.unique(np.concatenate([fps, queries]), return_inverse=True)
    node_id, query_id = index[:len(fps)], index[len(fps):]
    cells = np.cumsum(np.diff(at)[tree_of])
    labels, lo = np.arange(len(values)), 0
    while lo < len(queries):
        hi = max(lo + 1, int(np.searchsorted(cells, (cells[lo - 1] if lo else 0) + WALK_CELLS, side="right")))
        q, v = forest.within(queries[lo:hi], tree_of[lo:hi], radius)
        labels = forest_labels(query_id[lo + q], node_id[v], len(values), labels)
        lo = hi
    linked = np.flatnonzero(labels != np.arange(len(values)))
    return values[linked].view(np.int64), values[labels[linked]].view(np.int64)


def walk_trees(trees: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) of fingerprints: every query block of a shard against the shard's trees.

    The queries of a tree are its own nodes and those of the shard's later trees.
    """
    copies = F.col("n_trees") - F.col("tree")       # a tree is sent once for each block that walks it
    rows, nodes = trees.agg(F.sum(copies), F.sum(F.size("fps") * copies)).first()
    spread = trees.select("shard", "bits", F.explode(F.sequence("tree", F.col("n_trees") - 1)).alias("block"),
                          "fps", "parents", "edges")
    queries = trees.select("shard", "bits", F.col("tree").alias("block"), F.col("fps").alias("queries"))
    pairs = queries.join(bounded(spread, 1, 160 * (rows or 0) + 16 * (nodes or 0)), ["shard", "bits", "block"]).select(
        "fps", "parents", "edges", "queries")

    def walk(batches):
        import pyarrow as pa

        def flat(col, kind):
            at = col.offsets.to_numpy().astype(np.int64)
            return col.values.to_numpy(zero_copy_only=False)[at[0]:at[-1]].astype(kind, copy=False), at - at[0]
        for b in batches:
            fps, at = flat(b.column(0), np.int64)
            queries, q_at = flat(b.column(3), np.int64)
            found = _walk_rows((fps.view(np.uint64), flat(b.column(1), np.int64)[0], flat(b.column(2), np.int64)[0], at),
                               (queries.view(np.uint64), q_at), radius)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["a", "b"])
    return pairs.mapInArrow(walk, "a long, b long")


def _members(rows: DataFrame, radius: int, tree_nodes: int = TREE_NODES) -> DataFrame:
    """(fp, low, root) per distinct fingerprint: the smallest id that has it, and its component."""
    nodes = stage(rows.groupBy("fp").agg(F.min("id").alias("low")), "simhash-nodes")
    trees = stage(shard_trees(nodes, radius, tree_nodes), "simhash-trees")
    roots = components(walk_trees(trees, radius))
    return stage(nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root")), "simhash-members")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       shingle: int = SHINGLE_WORDS, radius: int = MAX_BITS,
                       tree_nodes: int = TREE_NODES) -> DataFrame:
    """(id, fp, component_id) per row; component_id is the smallest id reachable over links.

    Rows with one fingerprint are linked; so are null and empty texts
    (fingerprint 0). A null id is never the smallest: a component of null ids
    only has component_id NULL. Repeated rows each get their row.
    """
    rows = stage(fingerprints(docs, id_col, text_col, shingle), "simhash")
    member = _members(rows, radius, tree_nodes)
    low = stage(member.groupBy("root").agg(F.min("low").alias("component_id")), "simhash-low")
    ids = stage(member.join(low, "root").select("fp", "component_id"), "simhash-ids")
    return rows.join(ids, "fp").select("id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             shingle: int = SHINGLE_WORDS, radius: int = MAX_BITS) -> DataFrame:
    """The rows of docs without near-duplicates: of each component the row with the smallest id.

    Null ids come last and count like any other. Rows that share an id are
    told apart by their texts: of several in one component the smallest by
    the SHA-256 of its text stays, and of rows equal in id and text any one.
    """
    sha = F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256))
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), sha.alias("sha"))
    kind = T.StructType([T.StructField("fp", T.LongType())])
    rows = stage(map_texts(src, "text", ["id", "sha"], lambda: lambda texts: (
        np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64),), kind).select("row.*", "res.fp"),
        "simhash")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "sha"))
    best = rows.join(_members(rows, radius).select("fp", "root"), "fp").groupBy("root").agg(first.alias("x"))
    stay = stage(best.select(F.col("x.id").alias("stay"), F.col("x.sha").alias("sha")), "simhash-stay")
    twice = rows.groupBy("id", "sha").count().filter("count > 1").select(F.col("id").alias("stay"), "sha")
    twice = stage(stay.join(twice, stay["stay"].eqNullSafe(twice["stay"]) & (stay["sha"] == twice["sha"]), "left_semi"),
                  "simhash-twice")

    def among(df: DataFrame, keys: DataFrame, n: int, how: str) -> DataFrame:
        side = bounded(keys, n, 112)
        return df.join(side, df["row"][id_col].eqNullSafe(side["stay"]) & (df["text_sha"] == side["sha"]), how)
    n_twice = twice.count()
    kept = among(docs.select(F.struct("*").alias("row"), sha.alias("text_sha")), stay, stay.count(), "left_semi")
    if n_twice:     # only rows equal in id and text are shuffled whole
        one = (among(kept, twice, n_twice, "left_semi").groupBy(F.col("row").getField(id_col), "text_sha")
               .agg(F.first("row").alias("row")).select("row"))
        kept = among(kept, twice, n_twice, "left_anti").select("row").unionByName(one)
    return kept.select("row.*")


def hex_fp(col: str = "fp"):
    return F.lower(F.lpad(F.hex(col), 16, "0"))


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    found = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), hex_fp().alias("fingerprint"), "component_id")
