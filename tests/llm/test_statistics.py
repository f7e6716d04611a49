"""Whitening, collocations and quality rules against brute force and SQL."""

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from compare import digest

from tabloom.llm import collocations, quality, whitening

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


# ---- whitening

def plain_whitening(vectors, most=32):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    y = x - sums / n
    value, vector = np.linalg.eigh(y.T @ y / n)
    value, vector = value[::-1][:most], vector[:, ::-1][:, :most]
    gap = n * x.astype(object) - sums.astype(object)
    return (gap * gap).sum(axis=1), y @ vector, value, value / np.trace(y.T @ y / n)


@pytest.mark.parametrize("rows,d", [(4096, 7), (9, 7), (9, 40)])
def test_whitening(spark, rows, d, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_COLS", 16)        # several column blocks for 40
    monkeypatch.setattr(whitening, "SPLIT_BYTES", 2000)     # several splits of the middle dimension
    rng = np.random.default_rng(2)
    vectors = (rng.normal(0, 1, (60, d)) * np.linspace(3, 1, d) + np.linspace(-2, 5, d)).astype(np.float32)
    bad = [(100, None), (101, [float("nan")] + [0.0] * (d - 1)), (102, [None] + [1.0] * (d - 1)),
           (103, [float("inf")] * d), (104, [1.0] * (d + 1)), (105, [])]
    good = [(k, v.tolist()) for k, v in enumerate(vectors)] + [(None, vectors[3].tolist()), (5, vectors[5].tolist())]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<float>").repartition(4)
    df = df.selectExpr("*", "'x' id", "1 block", "2 n", "3 component")
    got = whitening.whiten(df, rows=rows).toPandas()
    most = min(32, d)
    dev, z, value, share = plain_whitening([v for _, v in good])
    assert len(got) == len(good) * most and set(got.n) == {len(good)}
    assert Counter(map(int, got.deviation)) == Counter({int(v): c * most for v, c in Counter(dev).items()})
    assert np.allclose(got.groupby("component").explained.first(), share, rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    own = got[got.id == 7].sort_values("component").whitened.to_numpy()
    assert np.allclose(np.abs(own), np.abs(z[7] / np.sqrt(value)), atol=1e-8)
    for a in (got, got[got.id.isna()]):     # one sign for all rows
        assert len(a) % most == 0
    wide = got[got.id.isin(range(60)) & (got.id != 5)].pivot(index="id", columns="component", values="whitened")
    signs = np.sign(wide.to_numpy() * z[[int(i) for i in wide.index]])
    assert (np.abs(signs.sum(axis=0)) == len(wide)).all()


def test_whitening_edges(spark):
    kind = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], kind)).count() == 0
    # One vector, and a dimension without variance.
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])], kind)).collect()
    assert [(r.whitened, r.explained, r.identity_error, int(r.deviation)) for r in one] == [(None, 0.0, None, 0)] * 2
    flat = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0])], kind)).collect()
    assert sorted((r.component, r.whitened is None) for r in flat) == [(1, False), (1, False), (2, True), (2, True)]
    big = np.array([[10 ** 12, -(10 ** 12)], [5, 6]])
    assert whitening._deviations(big, [int(s) for s in big.sum(axis=0)], 2) == [
        sum((2 * int(v) - int(s)) ** 2 for v, s in zip(row, big.sum(axis=0))) for row in big]


# ---- collocations

def brute_collocations(rows, top, least, displace=50):
    counts, n = defaultdict(Counter), Counter()
    for r in rows:
        lang = r[2] if r[2] is not None else "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1] or "")
        for piece in re.split(r"[.,;:!?\n-\r]", low):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in (1, 2, 3):
                counts[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        known = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in known.items():
            if len(p) == 2 and any(100 * b >= displace * a for q, b in known.items()
                                   if len(q) == 3 and p in (q[:2], q[1:])):
                continue
            score, k = min((10 ** 6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def phrase_rows():
    rng = np.random.default_rng(6)
    vocab = [f"w{k}" for k in range(14)] + ["é", "The", "x.y", "\x00", "😀"]
    weight = 1 / np.arange(1, len(vocab) + 1)
    text = [" ".join(rng.choice(vocab, rng.integers(0, 60), p=weight / weight.sum())) for _ in range(150)]
    text = [t.replace(" w3 ", "\t w3!  ").replace(" w5 ", ";\x0bw5 ") for t in text]
    rows = [(k, t, [None, "a", "b", "und"][k % 4], "s", 1) for k, t in enumerate(text)]
    rows += [(500, "new york city " * 40 + "new york " * 3, "a", "s", 1), (501, None, "c", None, None), (502, "", None, None, None)]
    return rows + [rows[3], rows[3]]


@pytest.mark.parametrize("top,first,limit", [(2000, 1.5, 2 << 20), (8, 0.1, 64), (3, 1.5, 1), (1, 0.01, 1000)])
def test_collocations(spark, top, first, limit):
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = collocations.find_collocations(docs, top=top, min_count=3, first_batch=first, limit=limit)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute_collocations(rows, top, 3)


def test_collocations_do_not_depend_on_the_flag_table(spark, monkeypatch):
    rows = phrase_rows()
    monkeypatch.setattr(collocations, "MAX_SLOTS", 4)       # nearly every branch collides
    got = collocations.find_collocations(spark.createDataFrame(rows, SCHEMA), top=5, min_count=3, first_batch=0.3)
    assert sorted(map(tuple, got.collect())) == brute_collocations(rows, 5, 3)


def test_collocation_edges(spark, docs, rows, clashing, empty):
    assert collocations.find_collocations(empty).count() == 0
    few = spark.createDataFrame([(1, "a b", "x", "s", 1)], SCHEMA)
    assert collocations.find_collocations(few).count() == 0
    want = brute_collocations(rows, 2000, 10)
    for df in (docs, clashing):
        assert sorted(map(tuple, collocations.find_collocations(df).collect())) == want


def test_exact_ratio(spark):
    rows = [(10 ** 13 - 7, 10 ** 13 - 3, 10 ** 13 - 5), (7, 9, 8), (999_999, 1_000_000, 1_000_000), (5, 5, 5)]
    df = spark.createDataFrame(rows, "a long, l long, r long")
    got = df.select(collocations.ratio("a", "l", "r"), collocations.ratio("a", "l")).collect()
    assert [tuple(x) for x in got] == [(10 ** 6 * a * a // (b * c), 10 ** 6 * a // b) for a, b, c in rows]


# ---- quality

def brute_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = defaultdict(list)
    for i in range(len(words) - 2):
        at[tuple(words[i:i + 3])].append(i)
    covered = {i + j for places in at.values() if len(places) > 1 for i in places for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(covered), sum(w.lower() in quality.STOP_WORDS for w in words), len(lines),
            sum(re.match(r"[\x20\x09]*[-*•]", x) is not None for x in lines),
            sum(re.search(r"(\.\.\.|…)[\x20\x09\x0d]*$", x) is not None for x in lines))


QUALITY = ["a b c a b c", "a a a a", "a a a", "a b", " - x\n * y\n• z\nplain", "wait...\nmore… \nend", "x\nx\n x\nx\r\nx\r",
           "The the of " * 30, "😀 é #tag $5 100% <b> | & *", "a\x0bb\x0cc\rd\te  f", "\n\n", "w " * 3000 + "z"]


def test_quality(spark, docs, rows, clashing, empty):
    extra = spark.createDataFrame(list(enumerate(QUALITY)), "doc_id long, text string")
    for df, want in ((docs, rows), (clashing, rows), (extra, list(enumerate(QUALITY)))):
        got = quality.apply_rules(df)
        assert got.select("row.*").columns == df.columns
        found = Counter((r["doc_id"], *r[1:]) for r in got.select("row.doc_id", *quality.MEASURES).collect())
        assert found == Counter((r[0], *brute_measures(r[1])) for r in want)
        for r in got.collect():
            m = dict(zip(quality.MEASURES, (r[c] for c in quality.MEASURES)))
            broken = []
            for rule in quality.RULES:
                under = m[rule.under] if rule.under else 1
                if under and not ((rule.least is None or m[rule.over] / under >= rule.least)
                                  and (rule.most is None or m[rule.over] / under <= rule.most)):
                    broken.append(rule.name)
            assert r.broken == broken and r.kept == (not broken)
    assert quality.apply_rules(empty).count() == 0


def test_quality_against_labels(spark):
    """Of the labelled texts that the base rules pass, the table drops the poor ones and none else."""
    sf = "/root/testdata/sf0.01"
    got = quality.op13_quality(spark, sf).filter("not base_failed").join(
        spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").groupBy("quality", "kept").count().collect()
    assert {(r.quality, r.kept) for r in got} == {(0, False), (1, True)}


@pytest.mark.parametrize("key", ["op12_collocations"])
def test_larger_table_matches_sql(spark, key):
    from tabloom.llm.queries import ORACLES, QUERIES
    sf = "/root/testdata/sf0.1"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    assert digest(QUERIES[key](spark, sf).toPandas()) == digest(con.execute(ORACLES[key]).df())
