"""Decontamination, secrets, toxicity and language id against brute force or held-out rows."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from llm.brute import brute_contamination
from pyspark.sql import functions as F

from tabloom.llm import decontaminate, langid, secrets, toxicity
from tabloom.llm.fm_index import FMIndex
from tabloom.llm.shared import fold

SF = "/root/testdata/sf0.01"
SF1 = "/root/testdata/sf0.1"
def contamination(df, bench, **kw):
    found = decontaminate.find_contamination(df, bench, carry=["doc_id"], **kw)
    got = found.select("row.doc_id", "res.n_words", "res.n_hit", F.array_join("res.items", ","),
                       decontaminate.contaminated()).collect()
    return Counter(map(tuple, got))


@pytest.fixture(scope="module")
def bench_rows(rows):
    texts = [r[1] for r in rows if r[1] and len(r[1]) < 2000]
    cut = [" ".join(t.upper().split()[3:40]) for t in texts[40:60]]
    return [*enumerate(cut), (90, texts[0].split()[0]), (91, "unseen words here"), (92, None), (93, "!!"),
            (94, cut[0]), (95, " ".join(texts[2].split()[:5])), (7, cut[7])]


@pytest.mark.parametrize("window,block", [(13, 8 << 20), (4, 8 << 20), (13, 700)])
def test_contamination(spark, docs, rows, bench_rows, window, block):
    bench = spark.createDataFrame(bench_rows, "item_id long, text string")
    got = contamination(docs, bench, window=window, block_bytes=block)
    assert got == brute_contamination(rows, bench_rows, window)


def test_contamination_edges(spark, clashing, rows, empty, bench_rows):
    bench = spark.createDataFrame(bench_rows, "item_id long, text string")
    assert contamination(clashing, bench) == brute_contamination(rows, bench_rows, 13)
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination(clashing, none) == brute_contamination(rows, [], 13)
    assert decontaminate.find_contamination(empty, bench).count() == 0
    kept = decontaminate.find_contamination(clashing, bench).select("row.*")
    assert kept.columns == clashing.columns and kept.count() == clashing.count()


def test_fm_index_search_and_locate():
    rng = np.random.default_rng(0)
    text = rng.integers(1, 6, 400)
    index = FMIndex(text, 5)
    phrases = rng.integers(2, 6, (30, 4))
    lengths = rng.integers(1, 5, 30)
    lo, hi = index.search(phrases, lengths)
    for k in range(30):
        p = phrases[k, :lengths[k]]
        want = [i for i in range(len(text) - len(p) + 1) if (text[i:i + len(p)] == p).all()]
        assert sorted(index.locate(np.arange(lo[k], hi[k]))) == want


SECRETS = [
    (1, 'x password = "hunter2hunter2" API_KEY:abc, api-key: zz', 1),
    (2, "AKIA" + "A1" * 9 + " AKIA123 " + "deadbeef" * 4 + " " + "f" * 23, 1),
    (3, "toKen==a.b/c+d=e Secret:\t'notspaced' secret:   'spaced1'", 1),
    (4, "\U0001f600 é token=abcdefgh  " + "0123456789abcdef" * 2, 1),
    (5, "token=token=abcdefgh token:short token:" + "a" * 2000 + " AKIAAKIA" + "B" * 13 + " AKIA1AKIA" + "C" * 9, 1),
    (6, " ".join(f"{k:024x}" for k in range(1500)), 1),
    (7, "-----BEGIN RSA PRIVATE KEY----- ghp_" + "a" * 36 + " xoxb-1234567890ab eyJhbGciOiJI.eyJzdWIiOiIx.abcdefgh12", 1),
    (8, None, 1), (9, "", 1), (1, "password: repeatedid", 1), (None, "passwd=nullid99", 1), (None, None, None),
]


# The contract's patterns as given, failing matches dropped afterwards.
PLAIN = {"assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
         "access": (r"AKIA[A-Z0-9]+", 0, 20), "hex": (r"[0-9a-f]+", 0, 24)}


def brute_secrets(text, rules):
    out = []
    for rank, r in enumerate(rules):
        pattern, group, least = PLAIN.get(r.kind, (r.regex, 0, 0))
        for m in re.finditer(pattern, text or "", re.ASCII):
            if len(m[group]) >= least:
                out.append((m.start(), rank, m.end(), r.kind))
    return tuple(sorted(out))


def test_secrets(spark, clashing, rows, empty):
    rules = [*secrets.BASE, *secrets.MORE]
    df = spark.createDataFrame(SECRETS, "doc_id long, text string, id int").repartition(3)
    got = Counter((r.id, tuple(map(tuple, r.spans))) for r in secrets.scan_secrets(df).collect())
    assert got == Counter((r[0], brute_secrets(r[1], rules)) for r in SECRETS)
    got = Counter((r.id, tuple(map(tuple, r.spans))) for r in secrets.scan_secrets(clashing).collect())
    assert got == Counter((r[0], brute_secrets(r[1], rules)) for r in rows)
    assert secrets.scan_secrets(empty).count() == 0


def test_trigram_queries():
    assert secrets.trigram_query(r"[0-9a-f]+") is None
    assert secrets.trigram_query("AKIA[A-Z0-9]+") == [["aki", "kia"]]
    assert secrets.trigram_query("(abcd|xyz)?foo") == [["foo"]]
    assert secrets.trigram_query("(abc|de)") is None
    assert secrets.trigram_query("x[ab]yz") == [["ayz", "xay"], ["byz", "xby"]]
    assert secrets.trigram_query("(?:ab){2}c") == [["aba", "abc", "bab"]]


def test_secrets_query(spark):
    rules = secrets.BASE
    text = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    for r in secrets.op7_secrets(spark, SF).collect():
        spans = brute_secrets(text[r.doc_id], rules)
        joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == k for s in spans) for k in range(3))


def test_folding_and_matching():
    m = toxicity.Matcher({"idiot": 2.0, "clown": 1.0}, ["clown fish"])
    assert [m.hits(t) != [] for t in ("an 1d1ot!", "іdiоt", "IDÌOT!!", "idiots", "a CLOWN", "idiotic")] == \
        [True, True, True, False, True, False]
    assert m.hits("the clown  fish") and not m.hits("the clown fish swims")
    assert len(m.hits("clown fish and clown")) == 1
    assert m.value("idiot") > m.value("idiot among many other words")
    assert toxicity.Matcher({}).hits("idiot") == []
    text = "".join(map(chr, range(1, 0x3000)))
    assert len(toxicity.fold_text(text)) == len(text)


def auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_toxicity_on_held_out_rows(spark):
    got = toxicity.op8_toxicity(spark, SF1)
    docs = spark.read.parquet(f"{SF1}/documents.parquet")
    both = got.join(spark.read.parquet(f"{SF1}/labels.parquet"), "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    held = both.filter("held_out and lang = 'en'").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in held)
    assert auc([(r.score, r.toxic) for r in held]) > 0.93
    assert sum(r.predicted and not r.toxic for r in held) == 0
    assert got.count() == docs.count()


def test_toxicity_recall_of_each_language(spark):
    docs = spark.read.parquet(f"{SF1}/documents.parquet").select("doc_id", "lang")
    both = toxicity.op8_toxicity(spark, SF1).filter("held_out").join(
        spark.read.parquet(f"{SF1}/labels.parquet"), "doc_id").join(docs, "doc_id")
    found = {(r.lang, r.toxic): (r.hit, r.n) for r in both.groupBy("lang", "toxic").agg(
        F.sum("predicted").alias("hit"), F.count("*").alias("n")).collect()}
    for lang in ("en", "de", "fr", "es"):
        hit, n = found[lang, 1]
        assert hit >= 0.5 * n, lang
        hit, n = found[lang, 0]
        assert hit <= 0.02 * n, lang


ABUSE = ["you are a filthy vermin and nobody wants you here", "what a wretched swine you must be today",
         "crawl back to your hole you wretched filthy vermin"]


def toxic_plants():
    """Clean texts, 120 of them with one of three set abusive sentences, and a clean passage repeated in toxic copies."""
    rng = np.random.default_rng(8)
    vocab = ["".join(rng.choice(list("bcdfgaeiou"), 6)) for _ in range(3000)] + "you are a and to be what your".split()
    text = [list(rng.choice(vocab, 60)) for _ in range(900)]
    rows = [(k, " ".join([*w[:30], ABUSE[k % 3], *w[30:]]) if k < 120 else " ".join(w), int(k < 120))
            for k, w in enumerate(text)]
    # Near copies of one post: the passage says the same in all, and only its end differs.
    passage = " ".join(f"calm{c}" for c in "abcdefghijklmnopqrstuvwxyz")
    return rows + [(1000 + k, f"{passage} {k}x filthy vermin", 1) for k in range(40)]


def test_toxicity_learns_set_phrases(spark):
    rows = toxic_plants()
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    score = toxicity.fit(docs, labels).scorer()
    assert all(score(w) >= 0.5 for w in ("filthy", "vermin", "wretched", "swine"))
    assert all(score(t) >= 0.5 for k, t, y in rows if y and k < 1000)
    assert sum(score(t) >= 0.5 for _, t, y in rows if not y) == 0
    assert all(score(f"calm{c}") < 0.5 for c in "abcdefghijklm")    # one passage, however often copied


def test_toxicity_counts_copies_of_a_post_once(spark):
    """Near copies of one post are one use of each of its words, wherever in the post they stand."""
    rng = np.random.default_rng(9)
    vocab = ["".join(rng.choice(list("bcdfgaeiou"), 6)) for _ in range(800)]
    post = "you filthy vermin should leave this forum today and stay away for ever"
    rows = [(k, " ".join(rng.choice(vocab, 50)) + (" and stay for ever" if k % 40 == 0 else ""), 0) for k in range(900)]
    rows += [(2000 + k, f"{post} {vocab[k]} {vocab[-k - 1]}", 1) for k in range(80)]
    rows += [(3000 + k, " ".join([*rng.choice(vocab, 25), "wretched", *rng.choice(vocab, 25)]), 1) for k in range(60)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert set(model.terms) == {"wretched"}
    score = model.scorer()
    assert sum(score(t) >= 0.5 for _, t, y in rows if not y) == 0


def naive_hits(text, terms, exceptions):
    """All terms at word ends outside exception phrases, by plain search at every place of the folded text."""
    low = toxicity.fold_text(text)

    def places(phrase):
        p = toxicity.fold_text(phrase)
        return [(a, a + len(p)) for a in range(len(low) - len(p) + 1) if low[a:a + len(p)] == p
                and not (a and text[a - 1].isalpha()) and not (a + len(p) < len(text) and text[a + len(p)].isalpha())]
    excused = [x for e in exceptions for x in places(e)]
    return sorted((a, b, w) for t, w in terms.items() for a, b in places(t)
                  if not any(c <= a and b <= d for c, d in excused))


def test_toxicity_query_by_brute_force(spark):
    """op8's scores, from a plain search instead of the automaton."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    model.terms = model.terms or {"trash": 2.0, "idiot": 1.5}
    text = dict(docs.select("doc_id", "text").collect())
    matcher = toxicity.Matcher({**model.terms, "the": 0.5, "of the": 0.25}, ["of the and"])
    for t in text.values():
        assert sorted(matcher.hits(t)) == naive_hits(t, {**model.terms, "the": 0.5, "of the": 0.25}, ["of the and"])
    for r in toxicity.score_texts(docs, model, carry=["doc_id"]).select("row.doc_id", "res.score").collect():
        t = text[r.doc_id]
        x = sum(w for _, _, w in naive_hits(t, model.terms, model.exceptions)) / max(1, t.count(" ") + t.count("\n") + 1) ** 0.5
        want = model.scores[toxicity.value_bin(x)] * 0.998 + 0.001 + 0.0009 * x / (1 + x)
        assert abs(r.score - want) < 1e-9


def test_toxicity_edges(spark, docs, clashing, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (None, 1, 1), (2, 1, None)], none.schema)
    for labels in (none, one):
        model = toxicity.fit(docs, labels)
        assert model.terms == {} and 0 < model.scorer()("anything") < 1
    assert toxicity.score_texts(empty, model).count() == 0
    scored = toxicity.score_texts(clashing, model)
    assert scored.select("row.*").columns == clashing.columns
    assert all(0 <= r[0] <= 1 for r in scored.select("res.score").collect())


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.op10_langid(spark, SF).join(docs.select("doc_id", "lang", "text"), "doc_id")
    held = got.filter((fold("doc_id", 3) == 1) & (F.length("text") > 30)).collect()
    assert all(r.held_out and 0 <= r.score <= 1 for r in held)
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97


def test_language_query_by_brute_force(spark):
    """op10's predictions, from a plain backoff without caches or slices."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(docs)
    text = dict(docs.select("doc_id", "text").collect())

    def evidence(word):
        if word in model.words:
            return model.word_rows[model.words[word]].astype(float)
        for n in (4, 3, 2, 1):
            marked = f"^{word}$"
            known = [model.gram_rows[model.grams[g]].astype(float) for k in range(len(marked) - n + 1)
                     if (g := marked[k:k + n]) in model.grams]
            if known:
                return np.mean(known, axis=0) * 0.5 ** (5 - n)
        return np.zeros(len(model.languages))
    for r in langid.predict_languages(docs, model, carry=["doc_id"]).select("row.doc_id", "res.lang_pred", "res.score").collect():
        found = re.findall(r"[a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text[r.doc_id]).lower())
        if not any(c.isalpha() for c in text[r.doc_id]):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        total = model.prior + sum((evidence(w) for w in found), np.zeros(len(model.languages)))
        odds = np.exp(total - total.max())
        assert r.lang_pred == model.languages[int(np.argmax(total))]
        assert abs(r.score - odds.max() / odds.sum()) < 1e-3


def test_language_edges(spark, docs, clashing, empty):
    model = langid.fit(docs)
    assert model.languages == ["a", "b"]
    p = langid.Predictor(model)
    assert [p.predict(t)[0] for t in (None, b"", b"12 !?", "— »".encode())] == ["und"] * 4
    assert p.predict("é".encode())[0] in ("a", "b")
    assert langid.predict_languages(clashing, model).select("row.*").columns == clashing.columns
    nothing = langid.fit(empty)
    assert langid.predict_languages(docs, nothing).filter("res.lang_pred <> 'und'").count() == 0
    assert langid.predict_languages(empty, model).count() == 0
