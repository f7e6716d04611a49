"""Exact dedup by deterministic block naming, in DataFrame functions only.

Every text is cut into fixed-size byte blocks. The distinct blocks are sorted
into integer names; adjacent names are then paired and the distinct pairs
sorted into names again, until each document is one (level, name). Two
documents share that identity exactly if their texts are equal: a name stands
for one byte string at its level, an odd last block pairs with NULL, and
documents of different block counts end at different names.

The blocks are sorted inside buckets of their 64-bit hash. The sorted set of
a bucket holds the real block bytes, so two blocks with one hash get two
names; the hash only decides where blocks meet. A block that a third of all
rows repeat collapses in the map-side combine of the set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.shared import stage

BLOCK_BYTES = 4096


def _blocks(data: Column, size: int) -> Column:
    """Array of the fixed-size byte blocks of ``data``; the empty string is one empty block."""
    last = F.greatest(F.ceil(F.octet_length(data) / F.lit(size)), F.lit(1)) - 1
    return F.transform(F.sequence(F.lit(0), last.cast("int")),
                       lambda i: F.substring(data, i * F.lit(size) + 1, F.lit(size)))


def _sorted_names(distinct: DataFrame, cols: list[str]) -> DataFrame:
    """Integer names 0, 1, ... (with gaps between partitions) in the sort order of ``cols``."""
    return stage(distinct.orderBy(*cols).select(*cols, F.monotonically_increasing_id().alias("name")),
                 "names")


def block_identities(docs: DataFrame, id_col: str, text_col: str,
                     block_bytes: int = BLOCK_BYTES, hash_bits: int = 64) -> DataFrame:
    """(id, sha256, level, name) per row of ``docs``; equal (level, name) means equal text.

    ``hash_bits`` sets the width of the bucket hash; a small one is used in
    tests to make blocks share a bucket.
    """
    def bucket(block: Column) -> Column:
        h = F.xxhash64(block)
        return h if hash_bits == 64 else F.pmod(h, F.lit(1 << hash_bits))

    base = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"),
                       F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data"))

    found = base.select(F.explode(_blocks(F.col("data"), block_bytes)).alias("block"))
    buckets = stage(found.groupBy(bucket(F.col("block")).alias("h"))
                    .agg(F.array_sort(F.collect_set("block")).alias("set"))
                    .select("h", F.size("set").alias("n"),
                            F.when(F.size("set") > 1, F.col("set")).alias("set")), "buckets")
    ranks = buckets.select("h", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pos"))
    names = _sorted_names(ranks, ["h", "pos"])

    sha = F.sha2(F.col("data"), 256)
    shared = buckets.filter("n > 1").select("h", F.posexplode("set").alias("pos", "block"))
    if shared.isEmpty():
        symbols = F.transform(_blocks(F.col("data"), block_bytes),
                              lambda b: F.struct(bucket(b).alias("h"), F.lit(0).alias("pos")))
        rows = base.select("rid", "id", sha.alias("sha"), symbols.alias("symbols"))
    else:
        cut = (base.select("rid", "id", sha.alias("sha"),
                           F.posexplode(_blocks(F.col("data"), block_bytes)).alias("idx", "block"))
               .withColumn("h", bucket(F.col("block"))).join(shared, ["h", "block"], "left"))
        symbol = F.struct("idx", "h", F.coalesce("pos", F.lit(0)).alias("pos"))
        rows = (cut.groupBy("rid", "id", "sha").agg(F.array_sort(F.collect_list(symbol)).alias("symbols"))
                .withColumn("symbols", F.transform("symbols", lambda s: F.struct(s["h"], s["pos"]))))
    rows = stage(rows, "rows")

    one = F.size("symbols") == 1
    done = (rows.filter(one).select("rid", F.col("symbols")[0]["h"].alias("h"),
                                    F.col("symbols")[0]["pos"].alias("pos"))
            .join(names, ["h", "pos"]).select("rid", F.lit(0).alias("level"), "name"))
    seq = (rows.filter(~one).select("rid", F.size("symbols").alias("n"), F.posexplode("symbols").alias("idx", "s"))
           .select("rid", "n", "idx", F.col("s")["h"].alias("h"), F.col("s")["pos"].alias("pos"))
           .join(names, ["h", "pos"]).select("rid", "n", "idx", "name"))
    level, longest = 0, rows.agg(F.max(F.size("symbols"))).first()[0] or 1
    while longest > 1:
        level += 1
        longest = (longest + 1) // 2
        pairs = stage(seq.groupBy("rid", "n", F.expr("idx div 2").alias("idx"))
                      .agg(F.max(F.expr("if(idx % 2 = 0, name, null)")).alias("a"),
                           F.max(F.expr("if(idx % 2 = 1, name, null)")).alias("b")), "pairs")
        # NULL, the missing right half, sorts and joins as -1; names are never negative.
        pairs = pairs.withColumn("b", F.coalesce("b", F.lit(-1).cast("long")))
        named = pairs.join(_sorted_names(pairs.select("a", "b").distinct(), ["a", "b"]), ["a", "b"])
        left = f"ceil(n / {2 ** level}D)"
        done = done.union(named.filter(f"{left} = 1").select("rid", F.lit(level).alias("level"), "name"))
        seq = named.filter(f"{left} > 1").select("rid", "n", "idx", "name")
    return rows.select("rid", "id", "sha").join(done, "rid").select("id", "sha", "level", "name")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                block_bytes: int = BLOCK_BYTES, hash_bits: int = 64) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays. A null text counts as
    empty; a null id never wins over a known one, and a group of null ids
    only keeps its rows (keep_id NULL, kept true). A row repeated with its id
    is counted each time and each repeat of the largest id is kept. An empty
    table gives an empty result; other columns are not read.
    """
    ids = stage(block_identities(docs, id_col, text_col, block_bytes, hash_bits), "identities")
    # Staged, so that both sides of the join are plain exchanges and a hot group's rows can be split.
    groups = stage(ids.groupBy("level", "name").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")),
                   "groups")
    return ids.join(groups, ["level", "name"]).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


OP3_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
