import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from aerolith.llm import _links, balance, decontaminate, html_text, pitman_yor, quality_rules, simhash, warc

from aerolith.llm._links import forest_within, roots

from ..oracle import connect, same
from aerolith.llm import registry


@pytest.mark.parametrize("name", ["op3_host_rules", "op9_positional_index"])
def test_queries_equal_their_sql(spark, sf_dir, name):
    assert same(registry.queries()[name](spark, sf_dir), connect(sf_dir), registry.oracle_sql()[name]) == ""


def brute_print(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    s = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(prints):
    root = {d: d for d in prints}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {d: top(d) for d in ids}


def test_simhash_groups_equal_brute_force(spark):
    r = np.random.default_rng(3)
    words = [f"w{i}É" for i in range(50)]
    base = [" ".join(r.choice(words, 200)) for _ in range(12)]
    texts = [b if k == 0 else " ".join(b.split()[:-k] + ["changed"] * k) for b in base for k in range(6)] + ["", None, " \n", "One two", "one TWO", "a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = {i: brute_print(t) for i, t in enumerate(texts)}
    want = brute_groups(prints)
    for shard in (30_000, 8):
        got = {x.doc_id: (x.fingerprint, x.component_id) for x in simhash.grouped(df, shard=shard).collect()}
        assert got == {d: (f"{prints[d]:016x}", want[d]) for d in prints}
    assert simhash.grouped(df.limit(0)).count() == 0


def test_vantage_trees_find_all_close_pairs(monkeypatch):
    monkeypatch.setattr(_links, "LEAF_PAIRS", 64)
    r = np.random.default_rng(1)
    seed = r.integers(0, 1 << 63, 60, dtype=np.uint64)
    values = np.unique(np.concatenate([seed, *(seed ^ (np.uint64(1) << r.integers(0, 63, 60).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 63, 60).astype(np.uint64)) for _ in range(5))]))
    got = roots(forest_within(values, np.ones(len(values), bool), 4), len(values))
    close = np.argwhere(np.bitwise_count(values[:, None] ^ values[None, :]) <= 4)
    assert (got == roots(close, len(values))).all()
    home = r.random(len(values)) < 0.3
    got = roots(forest_within(values, home, 4), len(values))
    assert (got == roots(close[home[close[:, 0]] | home[close[:, 1]]], len(values))).all()


def test_host_verdicts_need_a_bad_host_and_a_failing_document(spark):
    good, odd = "plain words here are many and differ a lot " * 2, "some # words "
    text = lambda i, mark: " ".join(f"w{i}x{k}" + ("#" if mark and k % 12 == 0 else "") for k in range(60))
    rows = [(i, text(i, i % 10 > 0), "bad") for i in range(300)] + [(1000 + i, text(i, i == 0), "fine") for i in range(300)] + [(2000, None, None), (2001, "", "fine"), (2002, "few words", "fine"), (2003, "a b c " * 40, "fine")]
    out = {r.doc_id: r for r in quality_rules.judged(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert len(out) == len(rows) and good and odd
    assert not out[5].kept and out[10].kept and out[1000].kept and all(not out[i].kept and out[i].base_failed for i in range(2000, 2004))


def test_phrases_and_proximity(spark):
    docs = spark.createDataFrame([(1, "x A b! C d, e z"), (2, "a b q c d e"), (3, None), (4, "a b c d"), (None, "c d e a b c d e")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "a b c d e"), (8, "c d e"), (None, "zz"), (9, "")], "item_id long, text string")
    for parts in (1 << 20, 3):
        got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.matched(docs, bench, query_bytes=parts).collect()}
        assert got == {1: (7, 5, ["7", "8"]), 2: (6, 3, ["8"]), 3: (0, 0, []), 4: (4, 0, []), None: (8, 8, ["7", "8"])}
    near = {r.doc_id: r["items"] for r in decontaminate.matched(docs, bench, slack=1).collect()}
    assert near[2] == ["7", "8"]
    both = {r.doc_id: (r["items"], r.near_items) for r in decontaminate.matched(docs, bench, near=1).collect()}
    assert both[2] == (["8"], ["7", "8"]) and both[4] == ([], [])
    # the last word that is asked for stands in the next document alone
    cut = spark.createDataFrame([(1, "q a b c d"), (2, "e a b c d"), (3, "e")], "doc_id long, text string").coalesce(1)
    assert all(not r["items"] and not r.n_hit for r in decontaminate.matched(cut, bench.where("item_id = 7"), slack=3).collect())


def test_differencing_beats_dealing_and_keeps_groups(spark):
    r = np.random.default_rng(2)
    sizes = r.pareto(1.5, 600).astype(int) + 1
    parts = np.bincount(balance.differenced(sizes.tolist(), 7), sizes, 7)
    assert parts.max() <= max(sizes.max(), sizes.sum() / 7 * 1.001 + 1)
    rows = [(i, "t" * int(n)) for i, n in enumerate(r.integers(0, 400, 900))] + [(5000 + i, "same") for i in range(50)] + [(6000, None), (6000, None), (None, "x")]
    out = balance.sharded(spark.createDataFrame(rows, "doc_id long, text string"), shards=5).collect()
    assert len(out) == len(rows)
    texts = defaultdict(set)
    for x in out:
        texts[x.text_crc32, x["size"]].add(x.shard)
    assert all(len(s) == 1 for s in texts.values())
    slots = defaultdict(list)
    for x in out:
        slots[x.shard].append(x.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    load = Counter()
    for x in out:
        load[x.shard] += x["size"]
    assert max(load.values()) - min(load.values()) <= 900
    assert balance.sharded(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_archives_round_trip(spark, tmp_path):
    pages = [(3, "http://www.A.com/x", "same"), (1, "https://b.org:443/?q=1#f", "same"), (2, None, None), (9, "u", ""), (5, "http://c.de/p", "a\r\n\r\nb\r\n\r\n"), (6, "http://c.de/p", "WARC/1.1\r\n\r\n\r\n"), (7, "http://a.com/x", "é\0"), (None, "n", "alone"), (-1, "m", "below"), (None, "m", "below"), (12, "m", "below"), (8, "r", "twice"), (8, "r", "twice")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    warc.write(df, str(tmp_path / "w"), file_records=3)
    found = warc.capture_index(warc.read(spark, str(tmp_path / "w"), run_entries=2), range_entries=3).collect()
    rows = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in found if r.page_id != 8), key=str)
    assert rows == sorted([(None, 5, "response", None), (-1, 5, "response", None), (None, 5, "revisit", -1), (12, 5, "revisit", -1), (1, 4, "response", None), (2, 0, "response", None), (3, 4, "revisit", 1), (5, 10, "response", None), (6, 14, "response", None), (7, 3, "response", None), (9, 0, "revisit", 2)], key=str)
    assert sorted((r.record_type, r.refers_to) for r in found if r.page_id == 8) == [("response", None), ("revisit", 8)]
    order = [(r.url_key, r.captured, r.page_id is not None, r.page_id or 0) for r in sorted(found, key=lambda r: (r.range, r.rank))]
    assert order == sorted(order)


def test_captures_equal_brute_force(spark, tmp_path):
    pick = random.Random(4)
    pages = [(pick.choice([None, -1, *range(30)]), pick.choice([None, "http://a.org/1", "b.org", "http://c.org"]), pick.choice([None, "", "x", "y" * 70_000, "z\r\n\r\n", "hot", "hot", "hot"])) for _ in range(400)] + [(None, "b.org", "no id")] * 3
    df = spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, `KEY2` string")
    warc.write(df, str(tmp_path / "w"), file_records=50)
    found = warc.capture_index(warc.read(spark, str(tmp_path / "w"), run_entries=30), range_entries=70).collect()
    groups = defaultdict(list)
    for page_id, url, text in pages:
        groups[(text or "").encode()].append((page_id is None, page_id or 0, url or "", page_id))
    want = []
    for payload, own in groups.items():
        own.sort(key=lambda x: x[:3])
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        want += [(x[3], len(payload), digest, "revisit" if i else "response", own[0][3] if i else None) for i, x in enumerate(own)]
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found], key=str) == sorted(want, key=str)
    order = [(r.url_key, r.captured, r.page_id is not None, r.page_id or 0) for r in sorted(found, key=lambda r: (r.range, r.rank))]
    assert order == sorted(order)


def test_no_pages_give_no_captures(spark, tmp_path):
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert warc.capture_index(warc.read(spark, str(tmp_path / "w"))).count() == 0


def test_main_text_of_pages():
    page = "<html><body><nav><a href=/>Home</a></nav><article><h1>T &amp; U</h1><p>One <b>two</b>.<p>Three<br>four<script>x()</script></article><div class='comments'>no</div><footer>f</footer></body></html>"
    assert list(html_text.main_texts([page, None, ""], None)) == ["Home" and "T & U One two. Three four", "", ""]


def test_scores_count_and_improve_on_the_base(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()] + [(70001, None), (70002, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in pitman_yor.scored(df, chunk_bytes=60_000, bucket_bytes=60_000).collect()}
    tokens = {d: [*(t or "").encode().lower().split(), b"\n"] for d, t in rows}
    away = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in rows}
    c = Counter(w for d in tokens if not away[d] for w in tokens[d])
    n, v = sum(c.values()), len(c)
    for d, ws in tokens.items():
        r = out[d]
        base = sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (away[d], len(ws), sum(c[w] > 0 for w in ws), n)
        assert abs(r.base_score - base) < 1e-6 * abs(base) and r.score < 0
    assert sum(out[d].score for d in out if away[d]) > sum(out[d].base_score for d in out if away[d])


def test_more_buckets_than_come_together_are_bundled_again(spark, monkeypatch):
    import random

    from aerolith.llm import balance

    monkeypatch.setattr(balance, "BUCKET_GROUPS", 40)
    monkeypatch.setattr(balance, "MOST_BUCKETS", 3)
    monkeypatch.setattr(balance, "BUNDLES", 12)
    monkeypatch.setattr(balance, "LARGE", 40)
    pick = random.Random(7)
    sizes = {f"k{i}": pick.randint(1, 900) for i in range(3000)} | {"large": 200_000, "b7": 150_000}
    got = {r.key: r.shard for r in balance.shards_of_groups(spark.createDataFrame(list(sizes.items()), "key string, bytes long"), 5).collect()}
    assert set(got) == set(sizes)
    sums = [sum(v for k, v in sizes.items() if got[k] == s) for s in range(5)]
    assert max(sums) - min(sums) < 0.04 * sum(sums) / 5
