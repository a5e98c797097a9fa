import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolith.llm import codes, toxicity, whitening
from tests.oracle import connect, same

VECTOR = "vec_id long, embedding array<double>, label int, code string, note string"


def _prose(rng, n):
    return " ".join(rng.choice(["lemon", "river", "garden", "window", "paper", "silver", "morning", "bridge", "yellow", "market", "letter", "stone"], n))


@pytest.fixture(scope="module")
def model(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(420):
        words = _prose(rng, 80).split()
        bad = i % 3 == 0
        for k in range(0, 80, 10) if bad else ():
            words[k] = rng.choice(["zwergnase", "qualmkopf", "Xylobrute"])
        rows.append((i, " ".join(words), int(bad)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1, None), (None, 1)], "doc_id long, toxic int")
    return docs, labels, toxicity.fitted(docs, labels)


def test_toxic_words_are_found_in_texts_not_seen(spark, model):
    rng = np.random.default_rng(9)
    clean = [_prose(rng, 60) for _ in range(40)]
    toxic = [" ".join(f"{_prose(rng, 9)} {w}" for w in ("Qualmkopf", "xylobrute", "zwergnase", "qualmkopf!", "zwergnase", "xylobrute")) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(clean + toxic)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.scored(df, model[2], ["doc_id"]).collect()}
    assert max(got[i] for i in range(40)) < 0.1 and min(got[i] for i in range(40, 80)) > 0.5


def test_scores_have_edge_cases(spark, model):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "qualmkopf " * 40_000), (5, "x" * 100_000), (6, "lemon"), (6, "lemon"), (None, "river garden")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("features", F.lit("theirs")).withColumn("score", F.lit(1))
    got = toxicity.scored(df.drop("score"), model[2], ["doc_id"]).collect()
    assert len(got) == 8 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[1] == by[2] == by[3] and by[4] > by[6] and by[5] < 0.7
    assert toxicity.scored(df.limit(0), model[2], ["doc_id"]).collect() == []


def test_fit_without_a_class_or_rows(spark):
    docs = spark.createDataFrame([(i, f"river stone {i}") for i in range(30)], "doc_id long, text string")
    for labels in ([(i, 0) for i in range(30)], [(i, 1) for i in range(30)], []):
        fit = toxicity.fitted(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        got = [r.score for r in toxicity.scored(docs, fit, ["doc_id"]).collect()]
        assert max(got) - min(got) < 1e-9
        assert not labels or (got[0] > 0.5) == (labels[0][1] == 1)


def test_features_follow_the_gains():
    gains = [5, -3, 0, 2, 7, 7, -1, 0, 0, 1, 3]
    counts = np.zeros(2 * toxicity.SPAN + 1)
    for g in gains:
        counts[g + toxicity.SPAN] += 1
    top = sorted(gains)[::-1]
    want = [np.mean(gains), np.mean([max(g - 1, 0) for g in gains]), np.mean([max(g - 3, 0) for g in gains]), 7, np.mean(top[:3]), np.mean(top[:8]), 3 / 11, 5 / 11, math.log(12), np.mean([max(-g - 1, 0) for g in gains])]
    assert np.allclose(toxicity.features(counts), want)
    assert toxicity.features(np.zeros_like(counts)) == [0.0] * 10


def test_held_out_flag_and_threshold_of_the_query(spark, sf_dir):
    import zlib

    got = toxicity.op11_zstd_dictionaries(spark, sf_dir).collect()
    assert len(got) == 200
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7) for r in got)


@pytest.mark.parametrize("size", [1, 2, 5, 16])
def test_nearest_equals_brute_force(size):
    rng = np.random.default_rng(size)
    for top in (3, 400, 1 << 40):
        x, c = rng.integers(-top, top, (300, size)), rng.integers(-top, top, (37, size))
        c[7] = c[3]
        x[5] = c[7]
        index, error = codes.nearest(x, c)
        d = ((x[:, None].astype(object) - c[None].astype(object)) ** 2).sum(2)
        assert index.tolist() == d.argmin(1).tolist() and [int(e) for e in error] == d.min(1).tolist()


def test_sequency_order():
    rows = codes.transformed(np.eye(8, dtype=np.int64)).T
    assert [int((r[1:] != r[:-1]).sum()) for r in rows] == list(range(8))


def test_codes_equal_their_sql(spark, sf_dir):
    assert same(codes.op12_hadamard_codes(spark, sf_dir), connect(sf_dir), codes.ORACLE_SQL["op12_hadamard_codes"]) == ""


def _brute_codes(rows, parts=4, entries=256, rounds=4):
    kept = sorted(((i, v, y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = [[math.floor(1024 * c) for c in v] + [0] * (-len(v) % parts) for _, v, _ in kept]
    w = len(x[0]) // parts
    cut = [[v[p * w : p * w + w] for v in x] for p in range(parts)]
    books = [c[:entries] for c in cut]
    d = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    near = lambda v, book: min(range(len(book)), key=lambda e: (d(v, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            of = [near(v, books[p]) for v in cut[p]]
            own = {e: [v for v, o in zip(cut[p], of) if o == e] for e in set(of)}
            books[p] = [[sum(c) // len(own[e]) for c in zip(*own[e])] if e in own else b for e, b in enumerate(books[p])]
    out = []
    for k, (i, _, y) in enumerate(kept):
        of = [near(cut[p][k], books[p]) for p in range(parts)]
        out.append([i, "".join(f"{e:02x}" for e in of), sum(d(cut[p][k], books[p][e]) for p, e in enumerate(of)), y])
    sums = {y: sum(r[2] for r in out if r[3] == y) for y in {r[3] for r in out}}
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return sorted(((r[0], r[1], r[2], sums[r[3]], digest) for r in out), key=str)


def test_codes_with_bad_rows_ties_and_clashing_columns(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in rng.normal(size=6)], int(i) % 3) for i in range(60)]
    rows += [(3, rows[4][1], None), (None, rows[4][1], None), (5, rows[5][1], 2), (900, None, 1), (901, [1.0, None, 2.0, 0.0, 0.0, 0.0], 1), (902, [float("nan")] * 6, 1), (903, [float("inf")] + [0.0] * 5, None)]
    rows += [(1000 + i, rows[7][1], 0) for i in range(200)]
    df = spark.createDataFrame([(*r, "theirs", "theirs") for r in rows], VECTOR).repartition(5)
    got = codes.coded(df, entries=20).collect()
    assert sorted((tuple(r) for r in got), key=str) == _brute_codes(rows, entries=20)
    assert codes.coded(df.limit(0)).collect() == [] and codes.coded(df.where("vec_id = 902")).collect() == []
    with pytest.raises(ValueError):
        codes.coded(df.unionByName(spark.createDataFrame([(1, [1.0], 1, "", "")], VECTOR)))


def _brute_whitened(rows):
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for v in rows])
    n, sums = len(x), x.sum(0)
    c = x - sums / n
    e, v = np.linalg.eigh(c.T @ c / n)
    return n, ((n * x - sums) ** 2).sum(1), c @ v[:, ::-1], e[::-1]


@pytest.mark.parametrize("n,d,parts", [(400, 12, 7), (40, 5, 40), (6, 9, 2)])
def test_whitened_equals_eigh(spark, n, d, parts, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 3)
    rng = np.random.default_rng(d)
    x = rng.normal(size=(n, d)) * np.linspace(0.3, 2, d)
    x[n // 2 :: 3] = x[1]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame([(i, v, None, "a", "b") for i, v in [*rows, (None, None), (7, [None] * d), (8, [float("nan")] * d)]], VECTOR).repartition(parts)
    got = {(r.vec_id, r.component): r for r in whitening.whitened(df).collect()}
    count, deviation, projected, e = _brute_whitened([v for _, v in rows])
    firm = sum(v > 1e-12 * e.sum() for v in e[:8])
    assert len(got) == n * min(8, d)
    signs = {}
    for (i, k), r in got.items():
        assert r.n == count and r.deviation == deviation[i] and r.deviation_digits == str(deviation[i])
        assert abs(r.explained - e[k - 1] / e.sum()) <= 1e-10
        assert r.identity_error < 1e-9
        if k > firm:
            assert r.whitened is None
            continue
        want = projected[i, k - 1] / math.sqrt(e[k - 1])
        signs.setdefault(k, np.sign(want) * np.sign(r.whitened) if abs(want) > 1e-3 else None)
        assert abs(abs(r.whitened) - abs(want)) < 1e-7
    assert signs


def test_rank_one_updates_and_merging_keep_the_spectrum():
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(size=(300, 10)) * 300).astype(np.int64) + 100_000
    x[50:120] = x[3]  # equal rows: nothing new to span
    x[:, 4] = x[:, 2]  # a dimension that is none
    whole, halves = whitening.nothing(10), [whitening.nothing(10), whitening.nothing(10)]
    for i, row in enumerate(x):
        whole = whitening.added(whole, row)
        halves[i % 2] = whitening.added(halves[i % 2], row)
    c = x - x.mean(0)
    want = np.linalg.eigvalsh(c.T @ c)
    for s in (whole, whitening.merged(*halves)):
        assert s.n == 300 and (s.sums == x.sum(0)).all() and len(s.values) == 9
        assert np.abs(s.values - want[1:]).max() < 1e-9 * want.max()
        assert np.abs(s.vectors.T @ s.vectors - np.eye(9)).max() < 1e-10


def test_secular_roots_close_to_poles():
    d = np.array([0.0, 1.0, 1.0 + 1e-12, 5.0, 1e9])
    z2 = np.array([1e-20, 1.0, 1e-3, 1e-18, 4.0])
    pole, x = whitening.secular_roots(d, z2)
    roots = d[pole] + x
    assert (np.diff(roots) >= 0).all() and (roots >= d).all() and (roots[:-1] <= d[1:]).all()
    assert np.allclose(roots.sum(), d.sum() + z2.sum(), rtol=1e-12)


def test_whitening_edge_cases(spark):
    one = spark.createDataFrame([(1, [0.5, 0.25], 0, "", ""), (1, [0.5, 0.25], 0, "", "")], VECTOR)
    got = whitening.whitened(one).collect()
    assert len(got) == 4 and all(r.whitened is None and r.deviation == 0 and r.explained == 0.0 for r in got)
    assert whitening.whitened(one.limit(0)).collect() == []
    big = spark.createDataFrame([(i, [float(1 << 36) * (i % 2), 1.0], 0, "", "") for i in range(4)], VECTOR)
    got = whitening.whitened(big).collect()
    assert all(r.deviation is None and int(r.deviation_digits) == (2 * (1 << 46)) ** 2 for r in got)
