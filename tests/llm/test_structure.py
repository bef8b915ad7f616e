"""Whitening, periodic runs and winnowing against plain implementations and on awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from datumgate.llm import periodic_runs, whitening, winnowing
from datumgate.llm.queries import llm_queries
from datumgate.plans.tables import table

SPACES = re.compile("[^\x20\x09-\x0d]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 11


def spectrum(kind, d, rng):
    if kind == "flat":
        return 60 + 15 * rng.random(d)
    if kind == "repeated":
        return np.r_[np.full(4, 9.0), np.full(d - 4, 3.0)]
    if kind == "rank 3":
        return np.r_[np.ones(3), np.zeros(d - 3)]
    return 0.9 ** np.arange(d)


@pytest.mark.parametrize(
    "kind,d,count", [("flat", 64, 32), ("flat", 200, 10), ("falling", 300, 32), ("repeated", 200, 6), ("rank 3", 40, 32), ("falling", 5, 32)]
)
def test_jacobi_davidson_equals_a_dense_solver(kind, d, count):
    rng = np.random.default_rng(d)
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    a = (q * spectrum(kind, d, rng)) @ q.T
    a = (a + a.T) / 2
    values, basis = whitening.jacobi_davidson(lambda x: a @ x, d, count)
    top = np.linalg.eigvalsh(a)[::-1][:count]
    assert np.abs(values - top).max() <= 1e-12 * top[0]
    assert np.abs(a @ basis - basis * values).max() <= 1e-12 * top[0]
    assert np.abs(basis.T @ basis - np.eye(len(values))).max() < 1e-13


def test_whitening_query_equals_dense_algebra(spark, sf_small):
    rows = llm_queries()["op11_embedding_whitening"](spark, sf_small).toPandas()
    given = table(spark, sf_small, "embeddings").toPandas()
    x = np.floor(64 * np.array(given["embedding"].tolist(), float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(0)
    y = (n * x - sums) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1][:32], vectors[:, ::-1][:, :32]
    expected = y @ vectors / np.sqrt(values)
    assert len(rows) == 32 * n and set(rows["n"]) == {n}
    white = rows.pivot(index="vec_id", columns="component", values="whitened").loc[given["vec_id"]].to_numpy()
    flips = np.sign((white * expected).sum(0))
    assert np.abs(white - expected * flips).max() < 1e-8
    deviation = {int(i): int(((n * v - sums).astype(object) ** 2).sum()) for i, v in zip(given["vec_id"], x)}
    assert all(deviation[i] == d for i, d in zip(rows["vec_id"], rows["deviation"]))
    share = rows.groupby("component")["explained"].first().to_numpy()
    assert np.abs(share - values / np.trace(y.T @ y / n)).max() < 1e-12
    assert rows["identity_error"].nunique() == 1 and rows["identity_error"][0] < 1e-9


VECTORS = "vec_id long, embedding array<float>, label int, n string, Whitened int"


def test_whitening_awkward(spark):
    rng = np.random.default_rng(3)
    good = [(k, [float(v) for v in rng.standard_normal(3)], None, "x", 1) for k in range(30)]
    good += [good[0], (None, good[1][1], 7, None, None)]
    bad = [(90, None, 1, "x", 1), (91, [1.0, None, 2.0], 1, "x", 1), (92, [1.0, float("nan"), 2.0], 1, "x", 1)]
    bad += [(93, [float("inf"), 0.0, 0.0], 1, "x", 1), (94, [], 1, "x", 1), (95, [1.0, 2.0], 1, "x", 1)]
    out = whitening.whiten(spark.createDataFrame(good + bad, VECTORS))
    assert out.columns == ["vec_id", "embedding", "label", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = out.collect()
    assert sorted(r.vec_id or -1 for r in rows) == sorted(g[0] or -1 for g in good)
    white = np.array([r.whitened for r in rows])
    assert white.shape == (32, 3) and np.abs(white.T @ white / 32 - np.eye(3)).max() < 1e-10
    assert abs(sum(rows[0].explained) - 1) < 1e-12
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0
    assert whitening.whiten(spark.createDataFrame(bad[:4], VECTORS)).count() == 0
    alike = whitening.whiten(spark.createDataFrame([good[0]] * 5, VECTORS)).collect()
    assert [(r.n, r.deviation, r.whitened) for r in alike] == [(5, 0, [])] * 5
    with pytest.raises(OverflowError):
        whitening.whiten(spark.createDataFrame([(1, [3e38], 1, "x", 1)], VECTORS))


# 12


def plain_runs(x, min_length=12):
    out = []
    for q in range(1, len(x) // 2 + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            s = x[i : j + q]
            if j > i and len(s) >= max(min_length, 2 * q) and not any(s[d:] == s[:-d] for d in range(1, q)):
                out.append((i, len(s), q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def fibonacci(n):
    a, b = ["a"], ["a", "b"]
    while len(b) < n:
        a, b = b, b + a
    return b


def test_runs_equal_brute_force():
    rng = random.Random(5)
    for _ in range(150):
        texts = [None, "", " \n"]
        for _ in range(rng.randint(1, 5)):
            kinds, n = rng.choice([1, 2, 2, 3, 50]), rng.randint(0, 90)
            w = [str(rng.randrange(kinds)) for _ in range(n)]
            if rng.random() < 0.6 and n > 3:
                a = rng.randrange(n)
                p = 1 + rng.randrange(max(1, (n - a) // 2))
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            texts += [" ".join(w)] * rng.randint(1, 2)
        for text, (runs, collapsed) in zip(texts, periodic_runs.runs_of_texts(texts), strict=True):
            own = (text or "").split()
            assert runs == plain_runs(own)
            gone = {i for s, n, q in runs for i in range(s + q, s + n)}
            assert collapsed == (None if text is None else " ".join(w for i, w in enumerate(own) if i not in gone).encode())
    assert next(periodic_runs.runs_of_texts([" ".join(fibonacci(300))]))[0] == plain_runs(fibonacci(300))


def test_long_texts_stay_within_time():
    for own, count in ((["a"] * 300_000, 1), ([str(i) for i in range(300_000)], 0), (fibonacci(20_000), 5775)):
        assert len(next(periodic_runs.runs_of_texts([" ".join(own)]))[0]) == count


def test_transform_is_a_convolution():
    rng = np.random.default_rng(1)
    for prime, generator in periodic_runs.PRIMES:
        for size in (1, 2, 8, 64):
            a, b = (rng.integers(0, prime, (3, size)).astype(np.uint64) for _ in range(2))
            there = [periodic_runs.transformed(m, prime, generator) for m in (a, b)]
            product = there[0] * there[1] % np.uint64(prime)
            got = periodic_runs.transformed(product, prime, generator, inverse=True)
            for row in range(3):
                for k in range(size):
                    assert int(got[row, k]) == sum(int(a[row, i]) * int(b[row, (k - i) % size]) for i in range(size)) % prime


def test_runs_query_equals_brute_force(spark, sf_small):
    rows = {r.doc_id: r for r in llm_queries()["op12_periodic_runs"](spark, sf_small).collect()}
    docs = table(spark, sf_small, "documents").collect()
    assert len(rows) == len(docs)
    planted = 0
    for doc in docs:
        w = SPACES.findall(doc.text or "")
        n, h = len(w), zlib.crc32(str(doc.doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            planted += 1
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if n > 700:
            continue  # brute force is cubic
        runs, row = plain_runs(w), rows[doc.doc_id]
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        assert row.n_runs == len(runs)
        assert (row.start, row.length, row.period) == (best or (None, None, None))
        assert row.exponent_milli == (1000 * best[1] // best[2] if best else None)
        gone = {i for s, size, q in runs for i in range(s + q, s + size)}
        assert row.runs_sha256 == sha("".join(f"{s},{size},{q}\n" for s, size, q in runs))
        assert row.collapsed_sha256 == sha(" ".join(x for i, x in enumerate(w) if i not in gone))
    assert planted > 5


DOCS = "doc_id long, text string, Runs int, n_chars string, marks int, other array<string>"


def test_runs_awkward(spark):
    periodic = "x " + "a b c " * 5 + "y"
    rows = [(1, periodic, 1, "k", 2, None), (1, periodic, 1, "k", 2, None), (None, None, None, None, None, ["q"]), (2, "", 1, "", 1, [])]
    out = periodic_runs.detect_runs(spark.createDataFrame(rows, DOCS))
    assert out.columns == ["doc_id", "text", "n_chars", "marks", "other", "runs", "collapsed"]
    got = sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in out.collect()), key=str)
    assert got == sorted([(1, [(1, 15, 3)], "x a b c y")] * 2 + [(None, [], None), (2, [], "")], key=str)
    assert periodic_runs.detect_runs(spark.createDataFrame([], DOCS)).count() == 0
    plants = spark.createDataFrame(rows, DOCS).select(periodic_runs.with_planted_run(F.col("text"), F.col("doc_id")).alias("t"))
    assert sum(r.t is None for r in plants.collect()) == 1


# 13


def plain_marks(hashes, window=winnowing.WINDOW):
    """Rightmost least hash of each window, with its position."""
    out = []
    for i in range(max(1, len(hashes) - window + 1) if hashes else 0):
        part = hashes[i : i + window]
        place = i + max(k for k, h in enumerate(part) if h == min(part))
        if not out or out[-1] != (hashes[place], place):
            out.append((hashes[place], place))
    return out


def test_marks_equal_plain_winnowing(spark, sf_small):
    docs = table(spark, sf_small, "documents").select("doc_id", "text")
    tokens = winnowing.token_hashes(F.col("text"))
    grams = F.transform(winnowing._packed_grams(F.col("t"), winnowing.GRAM), winnowing._hash_of)
    both = winnowing.fingerprint(docs).withColumn("t", tokens).withColumn("g", grams)
    for row in both.collect():
        assert len(row.g) == (max(1, len(row.t) - winnowing.GRAM + 1) if row.t else 0)
        assert [(m.hash, m.position) for m in row.marks] == plain_marks(row.g)


@pytest.mark.parametrize("window", [1, 2, 3, 4, 7, 8, 13])
def test_windows_of_any_width(spark, window):
    rng = random.Random(window)
    values = [[rng.randrange(1000) for _ in range(n)] for n in (0, 1, 2, window, window + 1, 60)]
    frame = spark.createDataFrame([(v,) for v in values], "v array<bigint>")
    got = frame.select("v", winnowing._window_minima(F.col("v"), window).alias("m")).collect()
    for row in got:
        least = [min(row.v[i : i + window]) for i in range(max(1, len(row.v) - window + 1))] if row.v else []
        assert row.m == list(dict.fromkeys(least))


def test_a_shared_passage_leaves_a_common_mark(spark):
    rng = random.Random(2)
    word = lambda: "w" + str(rng.randrange(10**6))
    size = winnowing.GRAM + winnowing.WINDOW - 1
    rows = []
    for k in range(200):
        shared = [word() for _ in range(size)]
        left, right = ([*(word() for _ in range(rng.randrange(30))), *shared, *(word() for _ in range(rng.randrange(30)))] for _ in range(2))
        rows.append((k, " ".join(left), " ".join(right)))
    frame = spark.createDataFrame(rows, "k int, a string, b string")
    near = winnowing.likeness(winnowing.packed_marks(F.col("a")), winnowing.packed_marks(F.col("b")))
    assert frame.where(near == 0).count() == 0


def test_winnowing_query_edits_and_compares(spark, sf_small):
    rows = {r.doc_id: r for r in llm_queries()["op13_winnowing"](spark, sf_small).collect()}
    docs = sorted(table(spark, sf_small, "documents").select("doc_id", "text").collect(), key=lambda r: -r.doc_id)
    prints = {d.text: rows[d.doc_id].fingerprint for d in docs}
    hashes = lambda text: {m.split(":")[0] for m in text.split(",")} if text else set()
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for k, doc in enumerate(docs):
        text, after = doc.text, docs[(k + 1) % len(docs)].text
        half, row = len(text) // 2, rows[doc.doc_id]
        assert (row.n_chars, row.edited_sha256) == (len(text), sha(text[: len(text) - half] + after[:half]))
        assert row.fingerprint == prints[text]
        assert row.near_edited == pytest.approx(like(hashes(row.fingerprint), hashes(row.edited_fingerprint)))
        assert row.near_next == pytest.approx(like(hashes(row.fingerprint), hashes(prints[after])))
    assert len(rows) == len(docs)


def test_winnowing_awkward(spark):
    long = " ".join(f"word{i}" for i in range(30_000))
    han = "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏"
    rows = [(3, long, 1, "x", 2, None), (3, long, 1, "x", 2, None), (2, None, 1, None, None, []), (None, "", 1, "x", 1, [])]
    rows += [(1, "?! --", 1, "x", 1, []), (4, han, 1, "x", 1, []), (5, "One two.", 1, "x", 1, [])]
    out = winnowing.compare_with_edited(spark.createDataFrame(rows, DOCS))
    assert out.columns == ["doc_id", "text", "Runs", "other", "n_chars", "marks", "edited_text", "edited_marks", "near_edited", "near_next"]
    by = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(rows)
    assert (by[2].n_chars, by[2].marks, by[2].near_edited) == (0, [], 1.0)
    assert by[None].edited_text == "" and by[1].marks and by[5].marks
    assert len(by[4].marks) > 5 and 0 < by[4].near_edited < 1
    near = sorted(r.near_next for r in out.where("doc_id = 3").collect())
    assert near == [0.0, 1.0]  # one copy follows the other
    assert winnowing.compare_with_edited(spark.createDataFrame([], DOCS)).count() == 0
    [only] = winnowing.compare_with_edited(spark.createDataFrame(rows[:1], DOCS)).collect()
    assert only.near_next == 1.0
