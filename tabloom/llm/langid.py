"""Language identification, words first with backoff to shorter character n-grams.

A word that the model knows adds its log frequency in each language. An
unseen word is scored by its longest character n-grams that the model knows:
all of its n-grams of that length, averaged, and each step down costs a
penalty; below single characters it adds nothing. The word sums give a
posterior over the learned languages.

The model is fitted on a bounded sample of rows by a hash of the id
(``SAMPLE_ROWS``); its tables keep entries seen at least ``MIN_COUNT`` times,
so their size is bounded by the sample.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.shared import fold, map_texts, stage

SAMPLE_ROWS = 10_000
MIN_COUNT = 3
NGRAM = 4               # longest character n-gram, with word edges marked
STEP_COST = 0.5         # factor on the evidence for each step of backoff
CACHE_WORDS = 300_000
HOLD_OUT, HELD = 3, 1   # rows with crc32(id) mod 3 = 1 are never learned from
UNKNOWN = "und"

# A-Z is folded; digits, signs and white space separate; other bytes are kept.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes | None) -> list[str]:
    return text.translate(_TABLE).decode(errors="replace").lower().split() if text else []


def has_letter(text: bytes | None) -> bool:
    return any(c.isalpha() for c in (text or b"").decode(errors="replace"))


def ngrams(word: str, n: int) -> list[str]:
    marked = f"^{word}$"
    return [marked[k:k + n] for k in range(len(marked) - n + 1)]


class Model:
    """Log frequencies by language: one matrix row per known word and per n-gram."""

    def __init__(self, languages: list[str], words: tuple[dict, np.ndarray], grams: tuple[dict, np.ndarray],
                 prior: np.ndarray):
        self.languages, self.prior = languages, prior
        (self.words, self.word_rows), (self.grams, self.gram_rows) = words, grams

    def evidence(self, word: str) -> np.ndarray:
        at = self.words.get(word)
        if at is not None:
            return self.word_rows[at]
        for step, n in enumerate(range(NGRAM, 0, -1), 1):
            known = [at for g in ngrams(word, n) if (at := self.grams.get(g)) is not None]
            if known:
                return self.gram_rows[known].mean(axis=0) * np.float32(STEP_COST ** step)
        return np.zeros(len(self.languages), np.float32)


class Predictor:
    """Predictions of one Python worker, with a bounded cache of word evidence."""

    def __init__(self, model: Model):
        self.model = model
        self._clear()

    def _clear(self):
        self.at: dict[str, int] = {}
        self.rows = np.zeros((CACHE_WORDS, len(self.model.languages)), np.float32)

    def _row(self, word: str) -> int:
        k = self.at.get(word)
        if k is None:
            k = self.at[word] = len(self.at)
            self.rows[k] = self.model.evidence(word)
        return k

    def predict(self, text: bytes | None) -> tuple[str, float]:
        found = words(text)
        if not self.model.languages or not found or not has_letter(text):
            return UNKNOWN, 0.0
        total = self.model.prior.astype(np.float64)
        for lo in range(0, len(found), CACHE_WORDS // 4):
            part = found[lo:lo + CACHE_WORDS // 4]
            if len(self.at) + len(part) > CACHE_WORDS:
                self._clear()
            total = total + self.rows[[self._row(w) for w in part]].sum(axis=0, dtype=np.float64)
        odds = np.exp(total - total.max())
        best = int(np.argmax(total))
        return self.model.languages[best], float(odds[best] / odds.sum())


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        rows: int = SAMPLE_ROWS) -> Model:
    """Learn from rows with a language outside the held-out fold; equal texts count once.

    Rows with a null id belong to no fold and are not learned from. Ties of
    the prediction go to the language first in order of name.
    """
    train = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
                        ).filter(F.col("lang").isNotNull() & (fold("id", HOLD_OUT) != HELD))
    total = train.count()
    share = min(1.0, max(rows - 4 * math.sqrt(rows), 1) / max(total, 1))
    sample = stage(train.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
                   .filter("text is not null").dropDuplicates(["text", "lang"]).select("text", "lang"), "lang-sample")

    def counted(texts):
        from collections import Counter
        out = []
        for t in texts:
            out.append([{"word": w, "n": n} for w, n in Counter(words(t)).items()])
        return (out,)
    schema = T.StructType([T.StructField("words", T.ArrayType(T.StructType([
        T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])))])
    by_word = stage(map_texts(sample, "text", ["lang"], lambda: counted, schema)
                    .select("row.lang", F.explode("res.words").alias("w"))
                    .groupBy("lang", "w.word").agg(F.sum("w.n").alias("n")), "lang-words")

    marked = F.concat(F.lit("^"), F.col("word"), F.lit("$"))

    def grams_of(n: int):
        at = F.sequence(F.lit(1), F.length(marked) - (n - 1))
        return F.when(F.length(marked) >= n, F.transform(at, lambda k: F.substring(marked, k, F.lit(n)))).otherwise(
            F.array().cast("array<string>"))
    grams = F.flatten(F.array(*map(grams_of, range(1, NGRAM + 1))))
    by_gram = (by_word.select("lang", "n", F.explode(grams).alias("gram"))
               .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    share_of = {r["lang"]: r["n"] for r in sample.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(share_of)
    index = {x: k for k, x in enumerate(languages)}

    def table(rows: DataFrame, key: str, class_of) -> tuple[dict, np.ndarray]:
        """Matrix of log frequencies, add-half smoothed within the class of the entry."""
        at: dict[str, int] = {}
        cells = [(at.setdefault(r[key], len(at)), index[r["lang"]], r["n"])
                 for r in rows.filter(F.col("n") >= MIN_COUNT).toLocalIterator()]
        n = np.zeros((len(at), len(languages)), np.float64)
        for k, lang, count in cells:
            n[k, lang] = count
        kind = np.array([class_of(k) for k in at], np.int64)
        sums = np.array([n[kind == c].sum(axis=0) for c in range(NGRAM + 1)])
        return at, np.log((n + 0.5) / (sums[kind] + 1)).astype(np.float32).reshape(n.shape)

    word_rows = table(by_word, "word", lambda w: 0)
    gram_rows = table(by_gram, "gram", len)
    docs_n = sum(share_of.values())
    prior = np.array([math.log(share_of[x] / docs_n) for x in languages], np.float64)
    return Model(languages, word_rows, gram_rows, prior)


FIELDS = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def predict_languages(docs: DataFrame, model: Model, text_col: str = "text",
                      carry: list[str] | None = None) -> DataFrame:
    """``row`` (the carried columns) and ``res``: lang_pred, score.

    A null text, or one without a letter, is ``und`` with score 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        p = Predictor(shared.value)

        def run(texts):
            found = [p.predict(t) for t in texts]
            return [x for x, _ in found], [y for _, y in found]
        return run
    return map_texts(docs, text_col, carry if carry is not None else docs.columns, make, FIELDS)


def op10_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict_languages(docs, fit(docs), carry=["doc_id"]).select(
        "row.doc_id", F.coalesce(fold("row.doc_id", HOLD_OUT) == HELD, F.lit(False)).alias("held_out"),
        "res.lang_pred", "res.score")
