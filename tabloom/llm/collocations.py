"""Collocations of two and three words by best-first branch-and-bound growth.

Phrases grow by one word from counted prefixes. A branch is left unopened as
long as no phrase below it can matter, by bounds from the counts at hand:

* a phrase of ``min_count`` occurrences has parts of as many, so pairs grow
  from counted words, and triples x y z from counted pairs x y and y z;
* score(x y z) is at most 10^6 f(x y) / f(x), whatever z is, and at most
  10^6 f(y z) / f(z), whatever x is. Neither can be too low for any triple.

The frontier is opened best first, in batches: a batch opens, in each language
that is not settled, the branches whose bound reaches a level ``c`` and the
triples that could displace a pair of score ``c`` or more. From then on every
phrase of score ``c`` or more is counted and known to survive or not. The
language is settled once ``top`` of them survive, so the last score, its ties
included, lies at ``c`` or above; else the next batch takes a lower level.

The branches that are open travel to the tasks as a table of hashed flags of
bounded size. A collision opens a branch too many, which costs time; counts
and results are exact.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.ranking import top_k_per_group
from tabloom.llm.shared import bounded, stage, text_slices

TOP = 2000
MIN_COUNT = 10
DISPLACE = 50               # percent of a pair's occurrences that a longer phrase must have to displace it
SCALE = 1_000_000
CHUNK = 2 << 20             # text bytes counted at once
SLICE = 8 << 20             # text bytes of a batch sorted by language at once
MAX_SLOTS = 1 << 25         # bytes of the flag table at most
BLOCK_SLOTS = 1 << 16       # slots put together in one task
FIRST_BATCH, WIDER = 1.5, 4  # pairs at the first level per phrase wanted, and how much each batch widens that
BINS = 64                   # score classes per doubling from which levels are taken

KNOWN, PREFIX, SUFFIX, SETTLE = 1, 2, 4, 8

_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes(b + 32 if 65 <= b <= 90 else 46 if b in _SEPARATORS else 32 if b == 9 else b for b in range(256))


def word_chunks(data: bytes, limit: int = CHUNK):
    """Lists of the words of a text, ``b"."`` between its pieces, in chunks cut between pieces."""
    data, lo = data.translate(_TABLE), 0
    while lo < len(data):
        cut = data.find(b".", lo + limit)
        hi = len(data) if cut < 0 else cut
        yield data[lo:hi].replace(b".", b" . ").split()
        lo = hi


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (a * np.uint64(0xC2B2AE3D27D4EB4F) + b) * np.uint64(0x165667B19E3779F9)
        return h ^ (h >> np.uint64(32))


def _word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    from xxhash import xxh32_intdigest, xxh64_intdigest
    seed = xxh32_intdigest(lang.encode())
    return np.array([xxh64_intdigest(w, seed) for w in words], np.uint64)


def _grow(lang: str, tokens: list[bytes], k: int, flags: np.ndarray | None):
    """(distinct k-word phrases as an Arrow array, counts) of the open branches of a chunk."""
    import pyarrow as pa
    import pyarrow.compute as pc
    words = list(dict.fromkeys(tokens))
    code = dict(zip(words, range(len(words))))
    ids = np.fromiter(map(code.__getitem__, tokens), np.int64, len(tokens))
    keep = ids != code.get(b".", -1)
    if k > 1:
        h = _word_hashes(lang, words)[ids]
        for _ in range(k - 2):
            h = _mix(h[:-1], h[1:])
        found = flags[(h & np.uint64(len(flags) - 1)).astype(np.int64)]
        a, b = found[:-1], found[1:]
        live = (a & b & KNOWN) > 0
        if k > 2:
            live &= ((a & PREFIX) > 0) & ((b & SUFFIX) > 0) | (((a | b) & SETTLE) > 0)
        n = max(len(ids) - k + 1, 0)
        whole = np.ones(n, bool)
        for j in range(k):
            whole &= keep[j:j + n]
        keep = whole & live[:n]
    at = np.flatnonzero(keep)
    packed = ids[at]
    for j in range(1, k):
        packed = packed * len(words) + ids[at + j]      # a chunk has less than 2^20 distinct words
    _, first, count = np.unique(packed, return_index=True, return_counts=True)
    vocabulary = pa.array(words, pa.binary())
    parts = [vocabulary.take(pa.array(ids[at[first] + j])).cast(pa.string()) for j in range(k)]
    return (parts[0] if k == 1 else pc.binary_join_element_wise(*parts, " ")), count.astype(np.int64)


def _by_language(batch):
    """(language, its texts joined by separators) of a batch, slice by slice."""
    import pyarrow as pa
    for lo, n in text_slices(batch.column(1), SLICE):
        part = batch.slice(lo, n)
        column = part.column(0).dictionary_encode()
        for i, lang in enumerate(column.dictionary.to_pylist()):
            rows = np.flatnonzero(column.indices.to_numpy() == i)
            yield lang, b".".join(x for x in part.column(1).take(pa.array(rows)).to_pylist() if x)


def count_phrases(texts: DataFrame, k: int, flags=None, limit: int = CHUNK) -> DataFrame:
    """(lang, phrase, f) of the open k-word phrases of ``texts`` (lang, text as binary).

    With k = 1 every word, and under a null phrase the number of all words.
    """
    def run(batches):
        import pyarrow as pa
        table = np.frombuffer(flags.value, np.uint8) if flags is not None else None
        for batch in batches:
            for lang, data in _by_language(batch):
                for tokens in word_chunks(data, limit):
                    phrases, f = _grow(lang, tokens, k, table)
                    if k == 1:
                        phrases = pa.concat_arrays([phrases, pa.nulls(1, pa.string())])
                        f = np.r_[f, f.sum()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang]).take(pa.array(np.zeros(len(f), np.int32))), phrases, pa.array(f)],
                        names=["lang", "phrase", "f"])
    return (texts.mapInArrow(run, "lang string, phrase string, f long")
            .groupBy("lang", "phrase").agg(F.sum("f").alias("f")))


def flag_table(phrases: DataFrame, n: int) -> bytes:
    """Flags of (lang, phrase, flag) rows by the phrase's hash, as one byte a slot; at most ``MAX_SLOTS`` bytes."""
    slots = min(MAX_SLOTS, max(1 << 12, 1 << (4 * max(n, 1) - 1).bit_length()))
    size = min(slots, BLOCK_SLOTS)

    def place(batches):
        import pyarrow as pa
        for batch in batches:
            langs, names, flag = (c.to_pylist() for c in batch.columns)
            at = np.empty(len(names), np.int64)
            by: dict[str, list[int]] = {}
            for i, lang in enumerate(langs):
                by.setdefault(lang, []).append(i)
            for lang, rows in by.items():
                parts = [names[i].encode().split(b" ") for i in rows]
                k = len(parts[0])
                h = _word_hashes(lang, [w for p in parts for w in p]).reshape(-1, k)
                for _ in range(k - 1):
                    h = _mix(h[:, :-1], h[:, 1:])
                at[rows] = (h[:, 0] & np.uint64(slots - 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at // size), pa.array(at % size), pa.array(flag, pa.int32())],
                                             names=["block", "slot", "flag"])

    def pack(key, rows):
        import pandas as pd
        out = np.zeros(size, np.uint8)
        out[rows["slot"].to_numpy()] = rows["flag"].to_numpy()
        return pd.DataFrame({"block": [key[0]], "flags": [out.tobytes()]})
    placed = (phrases.select("lang", "phrase", F.col("flag").cast("int").alias("flag"))
              .mapInArrow(place, "block long, slot long, flag int")
              .groupBy("block", "slot").agg(F.bit_or("flag").alias("flag")))
    out = bytearray(slots)
    for r in placed.groupBy("block").applyInPandas(pack, "block long, flags binary").collect():
        out[r["block"] * size:(r["block"] + 1) * size] = r["flags"]
    return bytes(out)


def ratio(a: str, left: str, right: str | None = None) -> Column:
    """floor(SCALE a^2 / (left right)), or floor(SCALE a / left); exact, counts of up to 14 digits."""
    def wide(c: str) -> str:
        return f"cast({c} as decimal(14,0))"
    over = wide(a) if right is None else f"({wide(a)} * {wide(a)})"
    under = wide(left) if right is None else f"({wide(left)} * {wide(right)})"
    return F.expr(f"({over} * cast({SCALE} as decimal(7,0))) div {under}")


def _part(k: int, n: int) -> Column:
    """The first k words of a phrase (last for negative k)."""
    return F.substring_index("phrase", " ", k).alias(f"p{n}")


def _with_counts(phrases: DataFrame, names: dict[str, Column], counts: DataFrame, size: int) -> DataFrame:
    """Add one count per part: ``names`` maps the new column to the part; ``counts`` is (lang, phrase, f) of ``size`` rows."""
    for name, part in names.items():
        side = bounded(counts.select(F.col("lang").alias("lang_"), F.col("phrase").alias("part_"),
                                     F.col("f").alias(name)), size, 128)
        phrases = phrases.join(side, (F.col("lang") == F.col("lang_")) & (part == F.col("part_"))).drop("lang_", "part_")
    return phrases


def _levels(pairs: DataFrame, wanted: DataFrame, want: int) -> DataFrame:
    """(lang, c): about the ``want``-th highest score of the pairs of each language, 0 if there are fewer."""
    # Score classes: at most BINS per doubling, so a language has a bounded number of them.
    by = F.floor(F.log2(F.col("score") + 1) * BINS)
    sizes = pairs.groupBy("lang", by.alias("bin")).agg(F.count("*").alias("n"), F.min("score").alias("c"))
    down = Window.partitionBy("lang").orderBy(F.col("bin").desc())
    reached = (sizes.withColumn("upto", F.sum("n").over(down)).filter(F.col("upto") >= want)
               .groupBy("lang").agg(F.max("c").alias("c")))
    return wanted.join(reached, "lang", "left").select("lang", F.coalesce("c", F.lit(0)).alias("c"))


def find_collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = TOP,
                      min_count: int = MIN_COUNT, displace: int = DISPLACE, first_batch: float = FIRST_BATCH,
                      limit: int = CHUNK) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` surviving phrases of each language.

    A null language is ``und``. Null and empty texts have no words; rows
    repeated are counted as often as they come; ties in score and count go by
    the phrase's bytes. A language without a phrase of ``min_count``
    occurrences has no row, and so has an empty table.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"),
                        F.col(f"`{text_col}`").cast("binary").alias("text"))
    counted = stage(count_phrases(texts, 1, limit=limit).filter(
        F.col("phrase").isNull() | (F.col("f") >= min_count)), "phrase-words")
    total = counted.filter("phrase is null").select("lang", F.col("f").alias("n"))
    words = counted.filter("phrase is not null")
    n_words = words.count()

    seeds = spark.sparkContext.broadcast(flag_table(words.withColumn("flag", F.lit(KNOWN)), n_words))
    found = stage(count_phrases(texts, 2, seeds, limit).filter(F.col("f") >= min_count), "phrase-found")
    seeds.unpersist()
    pairs = stage(_with_counts(found, {"f1": F.substring_index("phrase", " ", 1),
                                       "f2": F.substring_index("phrase", " ", -1)}, words, n_words)
                  .withColumn("score", ratio("f", "f1", "f2")).withColumn("prefix_bound", ratio("f", "f1"))
                  .withColumn("suffix_bound", ratio("f", "f2")), "phrase-pairs")
    n_pairs = pairs.count()

    settled, want = [], int(top * first_batch) + 1
    left = stage(pairs.select("lang").distinct(), "phrase-langs")
    while left.count():
        levels = stage(_levels(pairs, left, want), "phrase-levels")
        best, done = _settle(texts, pairs, n_pairs, words, n_words, levels, top, min_count, displace, limit)
        settled.append(best.join(done, "lang", "left_semi"))
        left = stage(left.join(done, "lang", "left_anti"), "phrase-langs")
        want *= WIDER
    if not settled:
        settled = [pairs.select("lang", "phrase", F.col("f").alias("a"), F.col("f1").alias("l"),
                                F.col("f2").alias("r"), "score", F.lit(1).alias("rank"))]
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n",
                                          "score")


def _settle(texts, pairs, n_pairs, words, n_words, levels, top, min_count, displace, limit):
    """Open the frontier of the languages in ``levels`` to their level.

    Returns the best ``top`` survivors at or above the level of each, and the
    languages for which they are final.
    """
    spark = texts.sparkSession
    at_level = pairs.join(levels, "lang")
    flag = (F.lit(KNOWN) + F.when(F.col("prefix_bound") >= F.col("c"), PREFIX).otherwise(0)
            + F.when(F.col("suffix_bound") >= F.col("c"), SUFFIX).otherwise(0)
            + F.when(F.col("score") >= F.col("c"), SETTLE).otherwise(0))
    frontier = spark.sparkContext.broadcast(flag_table(at_level.withColumn("flag", flag), n_pairs))
    grown = stage(count_phrases(texts.join(levels, "lang", "left_semi"), 3, frontier, limit)
                  .filter(F.col("f") >= min_count), "phrase-grown")
    frontier.unpersist()
    first, last = F.substring_index("phrase", " ", 2), F.substring_index("phrase", " ", -2)
    triples = _with_counts(grown, {"f1": F.substring_index("phrase", " ", 1),
                                   "f3": F.substring_index("phrase", " ", -1)}, words, n_words)
    triples = _with_counts(triples, {"f12": first, "f23": last}, pairs.select("lang", "phrase", "f"), n_pairs)
    cuts = F.array(F.struct(ratio("f", "f1", "f23").alias("score"), F.lit(1).alias("k"), F.col("f1").alias("l"),
                            F.col("f23").alias("r")),
                   F.struct(ratio("f", "f12", "f3").alias("score"), F.lit(2).alias("k"), F.col("f12").alias("l"),
                            F.col("f3").alias("r")))
    triples = stage(triples.withColumn("cut", F.array_min(cuts)).select(
        "lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score"), "phrase-triples")

    inside = (triples.select("lang", F.explode(F.array(first, last)).alias("phrase"), "a")
              .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    kept = (at_level.filter("score >= c").join(inside, ["lang", "phrase"], "left")
            .filter(F.col("longer").isNull() | (100 * F.col("longer") < displace * F.col("f")))
            .select("lang", "phrase", F.col("f").alias("a"), F.col("f1").alias("l"), F.col("f2").alias("r"), "score"))
    survivors = kept.unionByName(triples.join(levels, "lang").filter("score >= c").drop("c"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    best = stage(top_k_per_group(survivors, ["lang"], order, top, F.col("phrase"), "rank"), "phrase-best")
    done = levels.join(best.groupBy("lang").count(), "lang", "left").filter(
        (F.col("c") == 0) | (F.col("count") >= top)).select("lang")
    return best, stage(done, "phrase-done")


OP12_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
           FROM documents),
w AS (SELECT lang, regexp_extract_all(s, '[^\x20\x09]+') AS w
      FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS s FROM d)),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, p, count(*) AS f FROM (
        SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS p
        FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) AS v(k) WHERE len(w) >= k))
      GROUP BY lang, k, p),
c AS (SELECT lang, k, p, f, string_split(p, ' ') AS x FROM g WHERE k > 1 AND f >= 10),
s AS (SELECT lang, k, p, f, j, array_to_string(x[1:j], ' ') AS p1, array_to_string(x[j + 1:], ' ') AS p2
      FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
e AS (SELECT s.lang, s.k, s.p, s.f AS a, s.j, g1.f AS l, g2.f AS r,
             (1000000::HUGEINT * s.f * s.f // (g1.f::HUGEINT * g2.f))::BIGINT AS score
      FROM s JOIN g g1 ON g1.lang = s.lang AND g1.p = s.p1 JOIN g g2 ON g2.lang = s.lang AND g2.p = s.p2),
m AS (SELECT lang, k, p, a, l, r, score FROM e QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1),
i AS (SELECT lang, q, max(f) AS longer FROM (
        SELECT lang, f, unnest([x[1] || ' ' || x[2], x[2] || ' ' || x[3]]) AS q FROM c WHERE k = 3) GROUP BY lang, q),
o AS (SELECT m.* FROM m LEFT JOIN i ON i.lang = m.lang AND i.q = m.p WHERE m.k = 3 OR longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank, p AS phrase, a, l, r, n, score
FROM o JOIN n USING (lang) QUALIFY rank <= 2000
"""


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return find_collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
