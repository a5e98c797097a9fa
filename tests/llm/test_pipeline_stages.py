import random

import pytest
from aerolith.llm import decontaminate, near_sets, quality_rules, simhash

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n=80):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS)


def test_near_dedup_keeps_texts_that_only_share_an_id_or_have_none(spark):
    a, b, c, d, e = (prose(k) for k in range(5))
    rows = [(None, a), (None, b), (7, c), (7, d), (3, c), (7, d), (None, c), (9, e), (None, e)]
    out = simhash.stage(spark, frame(spark, rows), "").collect()
    # c goes for 3 and d of 7 stays, once; e stays for 9, a and b without an id
    assert sorted((str(r.doc_id), r.text) for r in out) == sorted((str(i), t) for i, t in [(None, a), (None, b), (3, c), (7, d), (9, e)])


def test_decontamination_keeps_clean_texts_of_a_contaminated_id(spark, tmp_path):
    item = prose(20, 30)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, item), (None, prose(21)), (5, item + " more"), (5, prose(22)), (5, prose(22)), (6, None)]
    out = decontaminate.stage(spark, frame(spark, rows), str(tmp_path)).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in out) == sorted((str(i), str(t)) for i, t in [rows[1], *rows[3:]])


def test_near_dedup_takes_five_words_and_a_similarity_of_four_fifths(spark):
    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    rows, passage = [], prose(99, 30)
    for k in range(60):
        w = prose(100 + k, 200).split()
        copy = list(w)
        for j in range(k % 12):
            copy[10 + 15 * j] = "changed"
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(copy))]
    rows += [(1000 + k, f"{prose(500 + k, 40)} {passage}") for k in range(30)]
    text = dict(rows)
    near = {k: len((a := shingles(text[2 * k])) & (b := shingles(text[2 * k + 1]))) / len(a | b) for k in range(60)}
    assert sum(0.8 <= x < 0.9 for x in near.values()) >= 10 and sum(x < 0.8 for x in near.values()) >= 10
    kept = {r.doc_id for r in simhash.stage(spark, frame(spark, rows), "").collect()}
    assert kept == set(text) - {2 * k + 1 for k in near if near[k] >= 0.8}


@pytest.mark.parametrize(("block", "group"), [(20_000, 4_000_000), (6, 900), (2, 300)])
def test_near_groups_equal_brute_force_however_blocks_and_groups_are_cut(spark, block, group):
    from pyspark.sql import functions as F

    rng, texts = random.Random(4), []
    for k in range(8):
        base = prose(300 + k, 150).split()
        for _ in range(12):
            w = list(base)
            for place in rng.sample(range(150), rng.randint(0, 9)):
                w[place] = f"c{rng.randint(0, 10**9)}"
            texts.append(" ".join(w))
    # a chain, in which only neighbours are similar; and short, empty and repeated texts
    long = prose(999, 400).split()
    texts += [" ".join(long[20 * k : 20 * k + 200]) for k in range(8)]
    texts += ["", None, " ", "one two", "ONE  two", "one two three", texts[0]]

    def shingles(t):
        w = (t or "").lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets, label = [shingles(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((label[i], label[j]))
                label = [x if z == y else z for z in label]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    found = near_sets.grouped(docs.select(key.alias("_key"), "text"), block=block, group=group).collect()
    assert {r._key.id: r.component_id.id for r in found} == dict(enumerate(label))
    assert len(set(label[:96])) > 8 and len(set(label[96:104])) == 1


@pytest.mark.parametrize("block", [100_000, 700])
def test_near_candidates_come_from_fingerprints_alone(spark, block):
    import numpy as np

    rng = np.random.default_rng(3)
    bits = rng.integers(0, 2, (3000, 256), dtype=np.uint8)
    # 300 pairs that differ as sets at 0.8 do, and a large group of near copies; all others are unrelated
    bits[1:600:2] = bits[0:600:2] ^ (rng.random((300, 256)) < 0.15)
    bits[1000:1400] = bits[1000] ^ (rng.random((400, 256)) < 0.05)
    values = np.packbits(bits, axis=1).view(np.int64).tolist()
    prints = spark.createDataFrame([(k + 1, *v) for k, v in enumerate(values)], "fp long, s0 long, s1 long, s2 long, s3 long")
    label = list(range(3001))
    for a, b in near_sets.candidates(prints, block=block).collect():
        x, y = sorted((label[a], label[b]))
        label = [x if z == y else z for z in label]
    want = {k: 1000 if 1000 <= k < 1400 else k - k % 2 if k < 600 else k for k in range(3000)}
    assert [label[k + 1] for k in range(3000)] == [want[k] + 1 for k in range(3000)]


def test_similar_sets_always_share_a_part():
    import numpy as np

    rng = np.random.default_rng(8)
    for size in [*range(1, 60), *rng.integers(60, 900, 300).tolist()]:
        # the most that may differ at 0.8: all more in one, or some in both
        less = int(rng.integers(0, size // 9 + 1))
        more = max((k for k in range(size) if 5 * (size - less) >= 4 * (size + k)), default=0)
        base = rng.integers(0, 1 << 63, size + more, dtype=np.uint64) * np.uint64(2)
        a, b = np.sort(base[:size]), np.sort(base[less:])
        assert 5 * (size - less) >= 4 * (size + more)
        key, of = near_sets.parts(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]))
        assert np.intersect1d(key[of == 0], key[of == 1]).size
    key, of = near_sets.parts(np.zeros(0, np.uint64), np.zeros(3, np.int64))
    assert not key.size and not of.size


def test_near_dedup_finds_pairs_whose_fingerprints_are_far_apart(spark):
    import numpy as np
    from pyspark.sql import functions as F

    # five shingles and four of them: a similarity of 0.8, seldom with fingerprints that far apart
    text = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    far = [5818, 21620, 37675, 40896]
    rows = [(2 * k + j, text(k, 9 - j)) for k in [*far, *range(40)] for j in (0, 1)]
    _, wide = near_sets.signatures(*near_sets.sets_of([t.encode() for _, t in rows]))
    assert (np.bitwise_count(wide[::2] ^ wide[1::2]).sum(axis=1)[: len(far)] > near_sets.FAR).all()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    for bucket in (near_sets.BUCKET, 7):
        found = near_sets.grouped(docs.select(key.alias("_key"), "text"), bucket=bucket).collect()
        assert {r._key.id: r.component_id.id for r in found} == {i: i - i % 2 for i, _ in rows}


def test_near_dedup_of_no_rows_and_with_columns_of_like_names(spark):
    a = prose(1)
    docs = spark.createDataFrame([(1, a, "x", "y", "z"), (2, a, "x", "y", "z"), (None, None, "p", None, "q")], "doc_id long, text string, _gone_id string, _row string, fp string")
    assert sorted(map(tuple, simhash.stage(spark, docs, "").collect()), key=str) == [(1, a, "x", "y", "z"), (None, None, "p", None, "q")]
    assert simhash.stage(spark, docs.limit(0), "").count() == 0


def test_texts_go_to_workers_in_small_batches_and_the_setting_comes_back(spark, monkeypatch):
    key, seen, own = "spark.sql.execution.arrow.maxBytesPerBatch", [], {}
    before = spark.conf.get(key)
    for module, name in ((near_sets, "signed"), (quality_rules, "measured")):
        own[name] = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, f=own[name], **b: (seen.append(spark.conf.get(key)), f(*a, **b))[1])
    docs = spark.createDataFrame([(1, prose(1), "s"), (2, prose(2), "s")], "doc_id long, text string, source string")
    assert simhash.stage(spark, docs, "").count() == quality_rules.stage(spark, docs, "").count() == 2
    assert seen == ["4m", "4m"] and spark.conf.get(key) == before
