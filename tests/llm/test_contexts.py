import tracemalloc

import numpy as np
import pyarrow as pa

from aerolith.llm import _spark, _words, pitman_yor


def test_words_are_scored_by_the_whole_word_before(spark):
    # all words end in the same byte, so only the whole word before tells which comes next
    follows = {f"w{k:02d}x": f"v{k:02d}x" for k in range(40)}
    rng = np.random.default_rng(3)
    pairs = list(follows.items())
    train = [i for i in range(4000) if not pitman_yor.held_out(i)][:800]
    test = [i for i in range(4000) if pitman_yor.held_out(i)][:2]
    rows = [(i, " ".join(" ".join(pairs[k]) for k in rng.integers(0, 40, 20))) for i in train]
    right = " ".join(" ".join(p) for p in pairs)
    wrong = " ".join(f"{pairs[k][0]} {pairs[(k + 1) % 40][1]}" for k in range(40))
    rows += [(test[0], right), (test[1], wrong)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {r.doc_id: r.score for r in pitman_yor.scored(df).collect()}
    split = {r.doc_id: r.score for r in pitman_yor.scored(df, chunk_bytes=20_000, bucket_bytes=20_000).collect()}
    for out in (whole, split):
        # 40 of 80 words are certain after theirs: each is worth log10(40) more than by frequency alone
        assert out[test[0]] > out[test[1]] + 60
        assert -40 * np.log10(40) * 1.15 - 5 < out[test[0]] < -40 * np.log10(40) * 0.9


def test_context_restaurants_grow_with_the_words(spark):
    g = pitman_yor.Gathered(1)
    g.add([1, 2], [b"the cat the dog", "на за на".encode()])
    b = pitman_yor.Bucket.of(g.rows(0)["packed"][1].as_py())
    # the start, the, cat, dog, and two words that end in the same byte
    assert len(b.contexts) == 6 and len(b.count) == 9


def test_tables_follow_the_restaurant_process():
    rng = np.random.default_rng(0)

    def one_by_one(c, d, a):
        t = 1
        for s in range(1, c):
            t += rng.random() < a / (a + s - d * t)
        return t

    for c, d, a in ((5, 0.8, 0.3), (40, 0.6, 2.0), (200, 0.5, 20.0)):
        want = np.array([one_by_one(c, d, a) for _ in range(2000)])
        for got in (pitman_yor.tables(np.full(2000, c), d, np.full(2000, a), rng), pitman_yor.tables(np.full(40, c), d, np.full(40, a), rng)):
            assert abs(got.mean() - want.mean()) < 5 * want.std() / len(got) ** 0.5 and got.min() >= 1 and got.max() <= c
    assert pitman_yor.tables(np.array([0, 1, 2]), 0.5, np.ones(3), rng).tolist()[:2] == [0, 1]


def test_held_out_texts_are_less_surprising_than_to_an_absolute_discount_bigram(spark):
    from collections import Counter, defaultdict

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").where("lang = 'en'")
    rows = docs.collect()
    texts = {r.doc_id: ["", *[x for x in (r.text or "").encode().lower().split()], ""] for r in rows}
    one, two = Counter(), defaultdict(Counter)
    for d, w in texts.items():
        if not pitman_yor.held_out(d):
            one.update(w[1:])
            for a, b in zip(w, w[1:]):
                two[a][b] += 1
    n, v = sum(one.values()), len(one)
    score = {}
    for d, w in texts.items():
        if pitman_yor.held_out(d):
            score[d] = 0.0
            for a, b in zip(w, w[1:]):
                p = (one[b] + 0.5) / (n + 0.5 * (v + 1))
                c = sum(two[a].values()) if a in two else 0
                score[d] += np.log10(max(two[a][b] - 0.75, 0) / c + 0.75 * len(two[a]) / c * p if c else p)
    own = {r.doc_id: r.score for r in pitman_yor.scored(docs).where("held_out").collect()}
    assert own.keys() == score.keys() and sum(own.values()) > sum(score.values())


def test_a_chunk_is_counted_and_sent_in_little_memory():
    rng = np.random.default_rng(4)
    texts = [" ".join(map(str, rng.zipf(1.3, 300) % 5000)).encode() for _ in range(2000)]
    g = pitman_yor.Gathered(8)
    g.add(list(range(2000)), texts)
    n = sum(map(len, g.tokens))
    tracemalloc.start()
    rows = 0
    for part in g.parts(0):
        assert part.num_rows == 1
        rows += 1
        del part
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # sorting with places and holding all rows took 37 bytes a token
    assert rows == 9 and peak < 30 * n


def test_pairs_are_counted_as_by_a_dictionary():
    from collections import Counter

    rng = np.random.default_rng(5)
    tokens, trained = rng.integers(0, 30, 4000).astype(np.uint32), rng.random(4000) < 0.7
    tokens[:3], tokens[-1] = [7, 7, 0], 0
    pairs = list(zip(tokens.tolist(), np.roll(tokens, 1).tolist()))
    want = Counter(p for p, x in zip(pairs, trained.tolist()) if x)
    word, context, count = pitman_yor.counted(tokens, trained)
    assert [(w, c, k) for w, c, k in zip(word.tolist(), context.tolist(), count.tolist())] == [(*p, want[p]) for p in sorted(set(pairs))]


def test_texts_are_cut_as_lists_of_them_are():
    texts = [b"a" * k for k in (0, 5, 3, 0, 12, 1, 1, 9, 0)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(texts, pa.binary())], ["doc_id", "text"])
    for size in (1, 6, 10, 100):
        assert list(_words.sliced(batch, size)) == [(list(range(a, b)), texts[a:b]) for a, b in _words.batches(texts, size)]
        assert list(_words.sliced(batch.slice(2, 5), size)) == [(list(range(2 + a, 2 + b)), texts[2 + a : 2 + b]) for a, b in _words.batches(texts[2:7], size)]


def test_long_texts_move_in_small_arrow_batches(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    texts = spark.range(0, 400, 1, 1).selectExpr("id", "cast(repeat('x', 50000) as binary) as text")
    most = lambda: texts.mapInArrow(sizes, "n long").agg({"n": "max"}).first()[0]
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    with _spark.small_batches(spark):
        assert most() < 5_000_000
    assert most() > 15_000_000 and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_tables_of_large_rows_have_small_row_groups(spark):
    import glob

    import pyarrow.parquet as pq

    rows = spark.range(0, 60, 1, 1).selectExpr("id as key", "repeat(sha2(cast(id as string), 512), 8192) as packed")
    held = _spark.bucketed(rows, "key", 1, "large_rows", _spark.LARGE_ROWS)
    files = [pq.ParquetFile(x) for x in glob.glob(held.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0] + "/*.parquet")]
    groups = [f.metadata.row_group(i).total_byte_size for f in files for i in range(f.num_row_groups)]
    # 60 MB in all, of which 100 rows were held before their size was looked at
    assert len(groups) > 4 and max(groups) < 11 << 20
    assert held.selectExpr("count(distinct packed)", "sum(length(packed))").first()[:] == (60, 60 << 20)
