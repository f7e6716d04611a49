"""Token files, WARC archives, mixing and the pipeline against brute force."""

import base64
import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm.brute import brute_components, brute_contamination
from pyspark.sql import functions as F

import corpus_pipeline
from tabloom.llm import mixing, token_files, toxicity, warc

SF = "/root/testdata/sf0.001"


def brute_tokens(rows, end=2):
    """Sorted by id; rows of one id in any order, so their starts are compared as a set."""
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(token_files.word_bpe_path())
    start, out = 0, []
    for r in sorted((r for r in rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids + [end]
        out.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


SPECIAL = [(1, "<|endoftext|> It's 'twas x y\x1czİstanbul é ΣΣ don't<|startoftext|>x"),
           (2, "A\tB　C 12345 ### $$$ café\x00\x07"), (3, "'s's'' ''re ́start")]


def test_token_files_round_trip(spark, docs, rows, tmp_path):
    rows = [r for r in rows if r[0] is not None] + [(1000 + k, t) for k, t in SPECIAL]
    df = docs.filter("doc_id is not null").select("doc_id", "text").unionByName(
        spark.createDataFrame([(1000 + k, t) for k, t in SPECIAL], "doc_id long, text string"))
    for by_word in (True, False):
        path = token_files.write_token_files(df, token_files.word_bpe_path(), by_word=by_word)
        got = token_files.token_digests(spark, path).orderBy("start").collect()
        assert [tuple(r) for r in got] == brute_tokens(rows)
    meta = token_files.read_metadata(spark, path).orderBy("start").collect()
    assert [tuple(r) for r in meta] == [r[:3] for r in brute_tokens(rows)]
    assert token_files.read_tokens(spark, path, [501, 502]).count() == 2
    plan = token_files.read_metadata(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "tokens:array" not in plan


def test_token_files_edges(spark, docs, rows, clashing, empty):
    path = token_files.write_token_files(clashing, token_files.word_bpe_path(), by_word=True)
    got = token_files.token_digests(spark, path).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter(
        (d, n, c) for d, _, n, c in brute_tokens(rows))
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == np.cumsum([0, *(r.n_tokens for r in ordered)])[:-1].tolist()
    path = token_files.write_token_files(empty, token_files.word_bpe_path())
    assert token_files.token_digests(spark, path).count() == 0


PAGES = [(k, f"http://x/{k} a\r\nb" if k == 3 else f"http://x/{k}", f"<p>{k % 7} é</p>" * (k % 5)) for k in range(60)]
PAGES += [(70, None, None), (71, "u", ""), (None, "u", PAGES[4][2]), (None, "v", "only null ids"),
          (None, "w", "only null ids"), (5, PAGES[5][1], PAGES[5][2]), (80, "big", "x" * 3_000_000)]


def test_warc_round_trip(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("sha", F.lit("clash"))
    index = warc.write_archives(df.repartition(4))
    first = {}
    for p, _, h in PAGES:
        if p is not None:
            first[h or ""] = min(first.get(h or "", p), p)
    want = Counter()
    for p, _, h in PAGES:
        f, data = first.get(h or ""), (h or "").encode()
        response = f is None or f == p
        want[(p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
              "response" if response else "revisit", None if response else f)] += 1
    got = warc.read_records(index).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    text = {p: (h or "").encode() for p, _, h in PAGES}
    assert all(bytes(r.payload) == text[r.page_id] for r in got if r.record_type == "response" and r.page_id is not None)
    some = warc.read_records(index.filter("url = 'big' or page_id = 3"))
    assert sorted(r.page_id for r in some.collect()) == [3, 80]
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_records(warc.write_archives(none)).count() == 0
    small = warc.write_archives(df, min_revisit_bytes=1)
    assert small.filter("page_id in (70, 71) and record_type = 'revisit'").count() == 0


def test_coalesced_ranges():
    assert warc.coalesced([(0, 10), (10, 5), (40, 5), (200, 1)], gap=30, most=100) == \
        [[0, 45, [0, 1, 2]], [200, 1, [3]]]
    assert warc.coalesced([(0, 10), (10, 5)], gap=30, most=10) == [[0, 10, [0]], [10, 5, [1]]]


def n_words(t):
    return len([w for w in (t or "").replace("\n", " ").replace("\t", " ").split(" ") if w])


def mixed(docs, rows, **kw):
    got = mixing.mix_sources(docs, **kw)
    assert got.select("row.*").columns == docs.columns
    found = got.select("row.doc_id", "row.source", "row.text", "mix.epoch", "mix.n_tokens", "mix.order_key").collect()
    size = defaultdict(int)
    for r in rows:
        size[r[3]] += n_words(r[1])
    assert all(r.n_tokens == n_words(r.text) for r in found)
    taken = defaultdict(int)
    for r in found:
        taken[r.source] += r.n_tokens
    return found, size, taken


def test_mixing_takes_every_document(docs, rows):
    found, size, taken = mixed(docs, rows, max_repeats=2.0)
    counts = Counter((r.doc_id, r.source, r.text) for r in found)
    assert set(counts) == {(r[0], r[3], r[1]) for r in rows}
    real = {s: n for s, n in size.items() if n}
    share = {s: n / sum(real.values()) for s, n in real.items()}
    # The exponent: the flattest with no source repeated more than twice, by plain bisection.
    lo, hi = 0.0, 1.0
    for _ in range(60):
        a = (lo + hi) / 2
        most = max(p ** a / n for p, n in zip(share.values(), real.values()))
        least = min(p ** a / n for p, n in zip(share.values(), real.values()))
        lo, hi = (lo, a) if most / least <= 2 else (a, hi)
    least = min(share[s] ** hi / real[s] for s in real)
    for s, n in real.items():
        repeats = share[s] ** hi / n / least
        longest = max(n_words(r[1]) for r in rows if r[3] == s)
        assert repeats * n - 1 <= taken[s] <= repeats * n + 2 * longest + 1
    # Whole epochs hold every document; the last is a prefix of its permutation.
    for s in real:
        mine = [r for r in found if r.source == s]
        last = max(r.epoch for r in mine)
        for e in range(last):
            assert Counter(r.doc_id for r in mine if r.epoch == e) == Counter(r[0] for r in rows if r[3] == s)


def test_mixing_entropy_and_budget(docs, rows):
    _, size, taken = mixed(docs, rows, target_entropy=1.0, max_repeats=None, budget_tokens=2000.0)
    weights = np.array([t for s, t in taken.items() if size[s]], float)
    assert sum(taken.values()) < 2000 + 40_000
    stats = docs.sparkSession.createDataFrame([(n, n / sum(size.values())) for n in size.values() if n],
                                              "tokens long, share double")
    a = mixing.choose_exponent(stats, None, 1.0, None)
    p = np.array([n / sum(size.values()) for n in size.values() if n]) ** a
    p /= p.sum()
    natural = np.array([n / sum(size.values()) for n in size.values() if n])
    entropy = lambda q: -(q * np.log(q)).sum()
    assert len(weights) and (a == 1.0 and entropy(natural) >= 1.0 or abs(entropy(p) - 1.0) < 1e-3 or a == 0.0)


@pytest.mark.parametrize("target", [0.1, 0.01, 0.32, 0.5, 0.69])
def test_mixing_meets_any_entropy(spark, target):
    sources = spark.createDataFrame([(900, 0.9), (100, 0.1)], "tokens long, share double")
    a = mixing.choose_exponent(sources, 500.0, target, None)
    p = np.array([0.9, 0.1]) ** a
    p /= p.sum()
    assert abs(-(p * np.log(p)).sum() - target) < 1e-3
    assert (a > 1) == (target < 0.3251)


def test_mixing_targets_out_of_reach(spark):
    even = spark.createDataFrame([(500, 0.5), (500, 0.5)], "tokens long, share double")
    with pytest.raises(ValueError, match="out of reach"):
        mixing.choose_exponent(even, None, 0.1, None)
    sources = spark.createDataFrame([(900, 0.9), (100, 0.1)], "tokens long, share double")
    with pytest.raises(ValueError, match="both"):
        mixing.choose_exponent(sources, None, 0.1, 2.0)
    docs = spark.createDataFrame([(k, "w " * 10, "ab"[k % 10 == 0]) for k in range(100)], "doc_id long, text string, source string")
    found = mixing.mix_sources(docs, target_entropy=0.1, max_repeats=None, budget_tokens=900.0)
    taken = dict(found.groupBy("row.source").agg({"mix.n_tokens": "sum"}).collect())
    assert taken["a"] > 860 and 0 < taken["b"] < 40


def test_mixing_edges(spark, clashing, rows, empty):
    found = mixing.mix_sources(clashing)
    assert found.select("row.*").columns == clashing.columns
    assert {r.doc_id for r in found.select("row.doc_id").collect()} == {r[0] for r in rows}
    assert mixing.mix_sources(empty).count() == 0
    wordless = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert mixing.mix_sources(wordless).count() == 2


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of every stage of the pipeline over a small table."""
    from tabloom.llm.shared import stage
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, function in corpus_pipeline.STAGES:
        after = stage(function(spark, docs, SF), "test")
        out.append((name, docs, after))
        docs = after
    return out


def test_pipeline(spark, stages):
    columns = stages[0][1].columns
    assert all(after.columns == columns for _, _, after in stages[:-1])
    take = lambda df: [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    (_, before, after), near, bench, mix, tokens = stages
    model = toxicity.fit(before, spark.read.parquet(f"{SF}/labels.parquet"))
    score = model.scorer()
    assert Counter(take(after)) == Counter(r for r in take(before) if score(r[1] or "") < 0.5)
    rows = take(near[1])
    _, comp = brute_components(rows)
    assert Counter(take(near[2])) == Counter(r for r, c in zip(rows, comp) if r[0] == c)
    rows = take(bench[1])
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {r[0] for r in brute_contamination(rows, items, 13) if r[4]}
    assert Counter(take(bench[2])) == Counter(r for r in rows if r[0] not in bad)
    assert set(take(mix[2])) == set(take(mix[1])) and max(Counter(take(mix[2])).values()) <= 3
    assert [tuple(r) for r in tokens[2].orderBy("start").collect()] == brute_tokens(take(tokens[1]))
    assert corpus_pipeline.run(spark, SF).count() == tokens[2].count()


def test_word_encoder_looks_a_word_up_once_per_slice(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(token_files, "CACHE_WORDS", 2)      # every repeat is a miss of the caches
    encoder, asked = token_files.WordEncoder(token_files.word_bpe_path()), Counter()
    make = encoder.words.make
    encoder.words.make = lambda w: asked.update([w]) or make(w)
    texts = [" one two\nthree  fourth, five. ", None, "", "five. one café cafİ İx ǆ ȿ ɇé à a\xff"] * 40
    found = pa.array([x and x.encode() for x in texts], pa.binary())
    ids, sizes = encoder.encode_all(found, 2)
    assert max(asked.values()) == 1
    lists = np.split(ids, np.cumsum(sizes)[:-1])
    whole, same = token_files.TextEncoder(token_files.word_bpe_path()).encode_all(found, 2)
    assert ids.tolist() == whole.tolist() and sizes.tolist() == same.tolist()
    assert [x.tobytes() for x in lists] == [encoder.encode(x.as_py()) + b"\2\0\0\0" for x in found]
    bad = pa.array([b"ab\xff cd\xc3", b"\xe4x"], pa.binary())
    assert encoder.encode_all(bad, 2)[0].tolist() == \
        token_files.TextEncoder(token_files.word_bpe_path()).encode_all(bad, 2)[0].tolist()


def test_word_encoder_keeps_plain_words_by_their_pieces_only():
    import pyarrow as pa
    letters = [chr(c) for c in range(0x41, 0x180) if chr(c).isalpha()]
    texts = [f"{c}{c}. x{c}y, {c}Q.,. {c}" for c in letters] + ["x1y don't \u0130s. ,", "", None]
    found = pa.array([t and t.encode() for t in texts], pa.binary())
    encoder = token_files.WordEncoder(token_files.word_bpe_path())
    ids, sizes = encoder.encode_all(found, 2)
    whole, same = token_files.TextEncoder(token_files.word_bpe_path()).encode_all(found, 2)
    assert ids.tolist() == whole.tolist() and sizes.tolist() == same.tolist()
    encoder = token_files.WordEncoder(token_files.word_bpe_path())
    plain = "Some some, SOME. some,. \u00c9t\u00e9 \u00e9t\u00e9, \u00c9T\u00c9."
    encoder.encode_all(pa.array([plain.encode()] * 3, pa.binary()), 2)
    assert not encoder.words.new and set(encoder.pieces.new) == {"some", "\u00e9t\u00e9", "", ",", ".", ",."}
