"""Benchmark decontamination with an FM-index per shard of the training texts.

A shard is a bounded slice of one task's rows. Its words become symbols: the
words of the test phrases keep a number of their own, every other word is a
separator, and stretches that cannot hold a phrase (too few words in a row
whose neighbouring pairs occur in phrases) are left out. The FM-index of the
rest is searched backwards for all phrases at once through wavelet-tree
ranks; occurrences are located through sampled suffix positions, mapped back
to document words, and merged into removal spans.

The phrases are read in blocks of bounded text size, each broadcast for one
pass over the shards; the rows carry their spans from pass to pass, so
documents are never shuffled.
"""

from __future__ import annotations

import uuid
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.fm_index import FMIndex
from tabloom.llm.shared import map_texts, stage

WINDOW = 13             # consecutive item words in a phrase
BLOCK_BYTES = 8 << 20   # benchmark text per broadcast block
RATIO = 20              # contaminated if RATIO * n_hit >= n_words
SHARD_BYTES = 2 << 20   # training text indexed at once; an index and its arrays take about 16 times that

# Word bytes are 0-9, a-z (A-Z folded) and everything from 0x80 on.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
               for b in range(256))

SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
FIELDS = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("spans", SPAN), T.StructField("items", T.ArrayType(T.StringType()))])


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


class Phrases:
    """The distinct windows of a block of (item_id, text), as symbol rows."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.symbol: dict[bytes, int] = {}
        found: dict[tuple, set] = {}
        for item, text in items:
            ids = tuple(self.symbol.setdefault(w, len(self.symbol) + 2) for w in words(text))
            for k in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(ids[k:k + window], set()).add(item)
        self.items = [sorted(x) for x in found.values()]
        self.lengths = np.array([len(p) for p in found], np.int64)
        self.rows = np.zeros((len(found), window), np.int64)
        for k, p in enumerate(found):
            self.rows[k, :len(p)] = p
        self.top = len(self.symbol) + 1
        self.shortest = int(self.lengths.min(initial=window))
        pair = self.rows[:, :-1] * (self.top + 1) + self.rows[:, 1:]
        self.pairs = np.unique(pair[self.rows[:, 1:] > 0])

    def occurrences(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, phrase) of every occurrence in the symbols ``ids`` (1 separates)."""
        if not len(self.lengths) or not len(ids):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        known = ids > 1
        if self.shortest > 1 and len(ids) > 1:
            key = ids[:-1] * (self.top + 1) + ids[1:]
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            joined = known[:-1] & known[1:] & (self.pairs[at] == key)
        else:
            joined = known[:-1] & known[1:]
        # A stretch is a run of known words joined by phrase pairs.
        begins = known & ~np.r_[False, joined]
        run = np.cumsum(begins) - 1
        length = np.bincount(run[known], minlength=int(run[-1]) + 1 if len(run) else 0)
        keep = np.flatnonzero(known & (length[np.maximum(run, 0)] >= self.shortest))
        if not len(keep):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        cut = np.flatnonzero(np.diff(run[keep]) != 0) + 1
        index = FMIndex(np.insert(ids[keep], cut, 1), self.top)
        where = np.insert(keep, cut, -1)
        lo, hi = index.search(self.rows, self.lengths)
        n = hi - lo
        phrase = np.repeat(np.arange(len(n)), n)
        row = np.arange(len(phrase)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        return where[index.locate(row)], phrase


def _search(block: Phrases, texts: list) -> list:
    """Per text: word count, spans of hit words, items."""
    docs = [words(t) for t in texts]
    sizes = np.array([len(d) for d in docs], np.int64)
    starts = np.r_[0, np.cumsum(sizes + 1)[:-1]] if len(docs) else np.empty(0, np.int64)
    get = block.symbol.get
    ids = np.ones(int((sizes + 1).sum()), np.int64)     # one separator after each document
    ids[np.delete(np.arange(len(ids)), starts + sizes)] = np.fromiter(
        (get(w, 1) for w in chain.from_iterable(docs)), np.int64, int(sizes.sum()))
    n_docs = len(docs)
    del docs        # the words are not needed beside the index
    at, phrase = block.occurrences(ids)
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + block.lengths[phrase], -1)
    hit = np.cumsum(edge[:-1]) > 0
    flip = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
    spans: list[list] = [[] for _ in range(n_docs)]
    items: list[set] = [set() for _ in range(n_docs)]
    for a, b, d in zip(flip[::2], flip[1::2], np.searchsorted(starts, flip[::2], side="right") - 1):
        spans[d].append((int(a - starts[d]), int(b - starts[d])))
    own = np.searchsorted(starts, at, side="right") - 1
    if len(at):
        for d, p in np.unique(np.stack([own, phrase], 1), axis=0):
            items[d].update(block.items[p])
    return [(int(n), s, i) for n, s, i in zip(sizes, spans, items)]


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int):
    """The number of blocks, and an iterator over them as lists of (item id as text, text).

    Items are dealt to blocks by a hash of their id, so that a block holds
    about ``block_bytes``; one block is on the driver at a time.
    """
    src = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"),
                           F.col(text_col).cast("binary").alias("text")).filter("text is not null")
    total = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    part = src.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(n)))
    return n, ([(r[0], bytes(r[1])) for r in part.filter(F.col("part") == k).select("item", "text").collect()]
               for k in range(n))


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text",
                       carry: list[str] | None = None, item_col: str = "item_id",
                       benchmark_text: str = "text", window: int = WINDOW,
                       block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``row`` (the carried columns) and ``res``: n_words, n_hit, spans, items.

    spans are merged word ranges [start, end); items are the ids, as text and
    sorted, of the benchmark items with an occurring window. A null or empty
    text has no words; an item without words has no window; repeated items
    count once; with an empty benchmark nothing is hit. A benchmark of more
    than ``block_bytes`` takes one pass per block, staged between passes.
    """
    carry = carry if carry is not None else docs.columns
    sc = docs.sparkSession.sparkContext
    n, blocks = _blocks(benchmark, item_col, benchmark_text, block_bytes)
    if n == 1:
        return map_texts(docs, text_col, carry, _scanner(sc.broadcast((next(blocks), window))), FIELDS, SHARD_BYTES)
    # Several blocks: carry the spans so far beside the row.
    cur = docs.select(F.struct(*[F.col(f"`{c}`") for c in dict.fromkeys([*carry, text_col])]).alias("doc"),
                      F.col(f"`{text_col}`").cast("binary").alias("body"), F.lit(None).cast(FIELDS).alias("sofar"))
    for items in blocks:
        block = sc.broadcast((items, window))
        step = map_texts(cur, "body", ["doc", "body", "sofar"], _scanner(block), FIELDS, SHARD_BYTES)
        cur = stage(step.select("row.doc", "row.body", _joined(F.col("row.sofar"), F.col("res")).alias("sofar")),
                    "decontaminate")
        block.unpersist()
    return cur.select(F.struct(*[F.col(f"doc.`{c}`").alias(c) for c in carry]).alias("row"),
                      F.col("sofar").alias("res"))


def _joined(old, new):
    """Union of two passes over one row: spans merged, items united, hits counted anew."""
    both = F.array_sort(F.concat(F.coalesce(old["spans"], F.array().cast(SPAN)), new["spans"]))
    merged = F.aggregate(both, F.array().cast(SPAN), lambda acc, s: F.when(
        (F.size(acc) > 0) & (s["start"] <= F.element_at(acc, -1)["end"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
            F.element_at(acc, -1)["start"].alias("start"),
            F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"))))).otherwise(
        F.concat(acc, F.array(s))))
    items = F.array_sort(F.array_union(F.coalesce(old["items"], F.array().cast("array<string>")), new["items"]))
    hits = F.aggregate(merged, F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return F.struct(new["n_words"].alias("n_words"), hits.alias("n_hit"), merged.alias("spans"),
                    items.alias("items"))


_loaded: dict = {}


def _scanner(block):
    """The text function of one pass; a Python worker builds the phrases of a block once."""
    key = uuid.uuid4().hex

    def make():
        if key not in _loaded:
            _loaded.clear()
            _loaded[key] = Phrases(*block.value)
        return lambda texts: _scan(_loaded[key], texts)
    return make


def _scan(phrases: Phrases, texts: list) -> tuple:
    found = _search(phrases, texts)
    spans = [merge_spans(s) for _, s, _ in found]
    return ([n for n, _, _ in found], [sum(b - a for a, b in s) for s in spans],
            [[{"start": a, "end": b} for a, b in s] for s in spans], [sorted(i) for _, _, i in found])


def contaminated(res: str = "res"):
    """The rule: any hit, and at least one word in ``RATIO`` hit."""
    return (F.col(f"{res}.n_hit") > 0) & (F.col(f"{res}.n_hit") * RATIO >= F.col(f"{res}.n_words"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS l, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS p
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
ls AS (SELECT DISTINCT l FROM bw),
dw AS (SELECT doc_id, l, i, array_to_string(w[i:i + l - 1], ' ') AS p
       FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, ls WHERE len(w) >= l)),
o AS (SELECT dw.doc_id, dw.i, dw.l, bw.item_id FROM dw JOIN bw ON dw.l = bw.l AND dw.p = bw.p),
h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS k FROM o) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS items_sha256
       FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM o) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
"""


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                               spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=["doc_id"])
    return found.select("row.doc_id", "res.n_words", "res.n_hit", F.size("res.items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("res.items", ","), 256).alias("items_sha256"),
                        contaminated().alias("contaminated"))
