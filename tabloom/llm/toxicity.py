"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding maps every character to one character: lower case, accents off,
homoglyphs to the Latin letter they look like, digits and signs to the letter
they stand for. Lexicon and texts are folded alike, so ``1d1ot`` and a word
with a Cyrillic letter meet the plain entry. Terms match at word ends only (of
the text as written), terms inside an exception phrase do not count, and the
summed weights are divided by a power of the text's length.

The lexicon, its weights, the exception phrases and the calibration of the
score are learned from labelled rows: a bounded sample of them by a hash of
the id (``SAMPLE_ROWS``), joined to the documents by a broadcast. That bound
also bounds the lexicon.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.components import components
from tabloom.llm.shared import bounded, fold, map_texts, stage

SAMPLE_ROWS = 20_000    # labelled rows to learn from, at most about this many
MAX_FDR = 0.01          # share of chance finds allowed among the terms
MIN_RATIO = 4.0         # how much commoner a term is in toxic texts than in others
LENGTH_POWER = 0.5
SHINGLE = 5             # words of a shingle
SKETCH = 16             # shingles of a text that are compared with other texts
BINS = 256
HOLD_OUT = 5            # rows with crc32(id) mod 5 = 0 are never learned from

# Characters that look like, or stand for, a Latin letter.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o",
    "р": "p", "с": "c", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u",
    "χ": "x", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ħ": "h",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "i", "€": "e",
}
# One class for i and l, which the same signs stand for.
MERGED = {"l": "i"}


class _Fold(dict):
    """Translation table that fills itself, one character to one character."""

    def __missing__(self, code: int) -> int:
        c = chr(code)
        low = c.lower()
        low = low if len(low) == 1 else c
        if low not in LOOKALIKES:
            plain = [x for x in unicodedata.normalize("NFKD", low) if not unicodedata.combining(x)]
            low = plain[0].lower() if len(plain) == 1 and len(plain[0].lower()) == 1 else low
        low = LOOKALIKES.get(low, low)
        low = " " if low.isspace() else MERGED.get(low, low)
        self[code] = ord(low)
        return self[code]


_FOLD = _Fold()
_WORD = re.compile(r"[^\W_]+")


def fold_text(text: str) -> str:
    """Folded text of the same length."""
    return text.translate(_FOLD)


def folded_words(text: str) -> list[str]:
    return _WORD.findall(fold_text(text))


class Matcher:
    """Aho-Corasick automaton of weighted terms and exception phrases."""

    def __init__(self, terms: dict[str, float], exceptions: list[str] = (), power: float = LENGTH_POWER):
        import ahocorasick
        self.power = power
        self.automaton = ahocorasick.Automaton()
        for t, w in terms.items():
            self.automaton.add_word(fold_text(t), (len(t), w))
        for p in exceptions:
            self.automaton.add_word(fold_text(p), (len(p), None))
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()

    def hits(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the terms that count."""
        if self.empty:
            return []
        found, excused = [], []
        for last, (n, weight) in self.automaton.iter(fold_text(text)):
            a, b = last - n + 1, last + 1
            if (a and text[a - 1].isalpha()) or (b < len(text) and text[b].isalpha()):
                continue
            (excused if weight is None else found).append((a, b, weight))
        if excused and found:
            excused.sort()
            ends, top = [], -1
            for _, b, _ in excused:
                top = max(top, b)
                ends.append(top)
            from bisect import bisect_right
            starts = [a for a, _, _ in excused]
            found = [h for h in found if not ((k := bisect_right(starts, h[0])) and ends[k - 1] >= h[1])]
        return found

    def value(self, text: str) -> float:
        """Summed weights over the number of words to the given power."""
        hits = self.hits(text)
        return sum(w for _, _, w in hits) / max(1, text.count(" ") + text.count("\n") + 1) ** self.power


def value_bin(x: float) -> int:
    """0 for no hit, else a logarithmic bin below ``BINS``."""
    return 0 if x <= 0 else min(BINS - 1, 1 + int(16 * math.log2(1 + 256 * x)))


def _decode(text: bytes | None) -> str:
    return (text or b"").decode(errors="replace")


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str,
                    rows: int) -> DataFrame:
    """(key, text, label) of a bounded sample, by hash of the id, of the rows to learn from.

    A document is positive if any of its label rows is; equal texts count once.
    """
    known = (labels.filter(F.col(label_col).isNotNull() & (fold(id_col, HOLD_OUT) != 0))
             .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label")))
    total = known.count()
    share = min(1.0, max(rows - 4 * math.sqrt(rows), 1) / max(total, 1))
    picked = known.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    side = bounded(picked, int(total * share) + 1, 64)
    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(side, "id")
            .groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
            .agg(F.first("text").alias("text"), F.max("label").cast("int").alias("label"))
            .select(F.col("sha").alias("key"), "text", "label"))


def _tail(t: int, n: int, p: float) -> float:
    """Chance of at least t positives among n documents if each is one with probability p."""
    if t <= 0:
        return 1.0
    term = math.exp(math.lgamma(n + 1) - math.lgamma(t + 1) - math.lgamma(n - t + 1)
                    + t * math.log(p) + (n - t) * math.log1p(-p))
    total = 0.0
    for k in range(t, n + 1):
        total += term
        if term < total * 1e-12:
            break
        term *= (n - k) / (k + 1) * p / (1 - p)
    return min(1.0, total)


def _beyond_chance(found: dict[str, tuple[int, int]], tested: int, pos: int, neg: int) -> dict[str, tuple[int, int]]:
    """Words whose counts differ beyond chance, by Benjamini and Hochberg over the ``tested`` words."""
    chance = sorted((_tail(t, t + c, pos / (pos + neg)), w) for w, (t, c) in found.items())
    keep = max((k for k, (p, _) in enumerate(chance, 1) if p <= MAX_FDR * k / tested), default=0)
    return {w: found[w] for _, w in chance[:keep]}


def sketch(text: str) -> list[int]:
    """The ``SKETCH`` smallest hashes of the text's distinct shingles of ``SHINGLE`` folded words."""
    words = folded_words(text)
    codes = np.array([zlib.crc32(w.encode()) + 1 for w in words], np.uint64)
    size = min(SHINGLE, max(len(words), 1))
    h = np.zeros(max(len(words) - size + 1, 0), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size if len(words) else 0):
            h = h * np.uint64(0x9E3779B97F4A7C15) + codes[j:j + len(h)]
            h ^= h >> np.uint64(29)
        h *= np.uint64(0xC2B2AE3D27D4EB4F)
    return np.unique(h ^ (h >> np.uint64(32)))[:SKETCH].view(np.int64).tolist()


def passage_groups(sample: DataFrame) -> DataFrame:
    """(key, group): texts that say mostly the same are one group.

    Two texts are linked if half of the one's sketch is in the other's. A
    text is compared with the smallest key that holds each of its hashes, so
    links never number more than hashes; groups are components of links.
    """
    known = T.StructType([T.StructField("h", T.ArrayType(T.LongType()))])
    hashes = stage(map_texts(sample, "text", ["key"], lambda: lambda texts: ([sketch(_decode(t)) for t in texts],), known)
                   .select("row.key", F.size("res.h").alias("size"), F.explode("res.h").alias("h")), "toxic-sketches")
    first = hashes.groupBy("h").agg(F.min("key").alias("low"))
    votes = hashes.join(first, "h").filter("low <> key").groupBy("key", "low").agg(
        F.count("*").alias("n"), F.first("size").alias("size")).filter("2 * n >= size")
    roots = components(votes.select(F.col("key").alias("a"), F.col("low").alias("b")))
    return sample.select("key").join(roots.withColumnRenamed("node", "key"), "key", "left").select(
        "key", F.coalesce("root", "key").alias("group"))


class Model:
    """Lexicon with weights, exception phrases, and the calibrated score of each bin."""

    def __init__(self, terms: dict[str, float], exceptions: list[str], scores: list[float]):
        self.terms, self.exceptions, self.scores = terms, exceptions, scores

    def scorer(self):
        matcher = Matcher(self.terms, self.exceptions)

        def score(text: str) -> float:
            x = matcher.value(text)
            return self.scores[value_bin(x)] * 0.998 + 0.001 + 0.0009 * x / (1 + x)
        return score


def _isotonic(pos: list[float], n: list[float]) -> list[float]:
    """Rising share of positives over the bins (pool adjacent violators)."""
    pools: list[list[float]] = []
    for p, m in zip(pos, n):
        pools.append([p, m, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            p2, m2, k2 = pools.pop()
            pools[-1] = [pools[-1][0] + p2, pools[-1][1] + m2, pools[-1][2] + k2]
    return [(p / m if m else 0.0) for p, m, k in pools for _ in range(int(k))]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", rows: int = SAMPLE_ROWS) -> Model:
    """Learn a ``Model`` from the labelled rows outside the held-out fold.

    A term is kept if it is much commoner in toxic texts (ratio), beyond
    chance (``MAX_FDR``). Texts that say mostly the same (``passage_groups``)
    count as one, positive if any of them is: all words of a post get one
    count, however often it was copied with changes, while a set phrase in
    unlike texts counts for each. Exception phrases are counted likewise.
    With no label, or one class only, the lexicon is empty and the score is
    the share of positives.
    """
    sample = stage(labelled_sample(docs, labels, id_col, text_col, label_col, rows), "toxic-sample")
    one_class = sample.select("label").distinct().count() < 2
    groups = stage(passage_groups(sample), "toxic-groups") if not one_class else None
    if one_class:
        pos, neg = (sample.filter(F.col("label") == y).count() for y in (1, 0))
        return Model({}, [], [(pos + 0.5) / (pos + neg + 2)] * BINS)
    member = stage(sample.join(groups, "key").select("group", "label", "text"), "toxic-members")
    label = stage(member.groupBy("group").agg(F.max("label").alias("label")), "toxic-labels")
    counts = {r[0]: r[1] for r in label.groupBy("label").count().collect()}
    pos, neg = counts.get(1, 0), counts.get(0, 0)
    base = (pos + 0.5) / (pos + neg + 2)
    if not pos or not neg:
        return Model({}, [], [base] * BINS)

    known = T.StructType([T.StructField("words", T.ArrayType(T.StringType()))])
    seen = map_texts(member, "text", ["group"], lambda: lambda texts: (
        [sorted(set(folded_words(_decode(t)))) for t in texts],), known)
    df = stage(seen.select("row.group", F.explode("res.words").alias("word")).distinct().join(label, "group")
               .groupBy("word").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c")), "toxic-words")
    ratio = (F.col("t") + 0.5) / pos / ((F.col("c") + 0.5) / neg)
    found = _beyond_chance({r["word"]: (r["t"], r["c"]) for r in
                            df.filter((ratio >= MIN_RATIO) & (F.col("t") >= 2)).collect()}, df.count(), pos, neg)
    terms = {w: math.log((t + 0.5) / (pos + 1)) - math.log((c + 0.5) / (neg + 1)) for w, (t, c) in found.items()}

    around = T.StructType([T.StructField("uses", T.ArrayType(T.StructType([
        T.StructField("word", T.StringType()), T.StructField("left", T.StringType()),
        T.StructField("right", T.StringType())])))])

    def uses(text):
        w = ["", *folded_words(_decode(text)), ""]
        return [{"word": x, "left": a, "right": b} for x, a, b in
                {(w[k], w[k - 1], w[k + 1]) for k in range(1, len(w) - 1) if w[k] in terms}]
    ctx = stage(map_texts(member, "text", ["group"], lambda: lambda texts: ([uses(t) for t in texts],), around)
                .select("row.group", F.explode("res.uses").alias("u")).select("group", "u.*").distinct()
                .join(label, "group"), "toxic-uses")

    # Exception phrases: a term with one neighbour, seen in several clean texts and hardly in toxic ones.
    pairs = (ctx.filter("left <> ''").select("group", "label", "word", F.concat_ws(" ", "left", "word").alias("p"))
             .union(ctx.filter("right <> ''").select("group", "label", "word", F.concat_ws(" ", "word", "right")))).distinct()
    excused = pairs.groupBy("word", "p").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c"))
    exceptions = [r["p"] for r in excused.filter((F.col("c") >= 4) & (F.col("c") >= 9 * F.col("t"))).collect()]

    held = T.StructType([T.StructField("bin", T.IntegerType())])

    def bins():
        m = Matcher(terms, exceptions)
        return lambda texts: ([value_bin(m.value(_decode(t))) for t in texts],)
    hist = {r["bin"]: (r["p"], r["n"]) for r in map_texts(member, "text", ["label"], bins, held)
            .groupBy("res.bin").agg(F.sum("row.label").alias("p"), F.count("*").alias("n")).collect()}
    # Empty bins take no part; they get the score of the next filled bin above, or below at the top.
    filled = sorted(hist)
    level = dict(zip(filled, _isotonic([hist[b][0] + base for b in filled], [hist[b][1] + 1.0 for b in filled])))
    scores = [level[min((f for f in filled if f >= b), default=filled[-1])] for b in range(BINS)]
    return Model(terms, exceptions, scores)


SCORE = T.StructType([T.StructField("score", T.DoubleType())])


def score_texts(docs: DataFrame, model: Model, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``row`` (the carried columns) and ``res.score``; a null text scores like an empty one."""
    def make():
        score = model.scorer()
        return lambda texts: ([score(_decode(t)) for t in texts],)
    return map_texts(docs, text_col, carry if carry is not None else docs.columns, make, SCORE)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_texts(docs, model, carry=["doc_id"]).select(
        "row.doc_id", F.coalesce(fold("row.doc_id", HOLD_OUT) == 0, F.lit(False)).alias("held_out"), "res.score",
        (F.col("res.score") >= 0.5).cast("int").alias("predicted"))
