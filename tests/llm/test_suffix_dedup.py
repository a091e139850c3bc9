import random

import numpy as np
from brute import repeats

import __spark_entry__
from lakesieve.llm import _bytes, suffix_dedup

Q = __spark_entry__.queries()


def planted():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, base = text(60), text(200)
    docs = [(i, text(rnd.randint(0, 80))) for i in range(60)]
    docs += [(100 + i, text(20) + passage[i : i + 150 + i] + text(20)) for i in range(30)]
    docs += [(200 + i, base[: 20 * i] + "X" + base[20 * i + 1 :]) for i in range(30)]
    docs += [(300, base), (50_000, base), (301, "a" * 500), (302, "a" * 99), (303, "ab" * 300), (304, "-" * 100 + "\n" + "-" * 101), (305, ""), (306, None), (307, passage * 3)]
    rnd.shuffle(docs)
    return docs


def rows(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def test_against_brute_force(spark, sf, tables, monkeypatch):
    monkeypatch.setattr(_bytes, "CHUNK_BYTES", 3000)  # many blocks
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", 2000)
    monkeypatch.setattr(suffix_dedup, "PIECE", 150)
    docs = planted()
    folder = tables(documents=docs)
    assert rows(Q["op1_suffix_dedup"](spark, folder)) == repeats(docs)
    whole = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert rows(Q["op1_suffix_dedup"](spark, sf)) == repeats(whole)


def test_ranges_keep_a_hash_together():
    part = lambda h: [np.array(h, np.uint64), *(np.arange(len(h)) for _ in range(4)), np.ones(len(h), np.uint8), np.zeros(100 * len(h), np.uint8)]
    parts = [part([1, 1, 2, 9]), part([]), part([2, 2, 2, 3])]
    got = [(o.tolist(), h.tolist(), len(b)) for o, h, *_, b in suffix_dedup._by_range(parts, 100)]
    assert sum(got, ()) == ([0, 0, 0, 0, 2, 2, 2, 2], [1, 1, 2, 9, 2, 2, 2, 3], 800)


def test_collisions_are_found(monkeypatch):
    # a hash that only adds up bytes calls every permutation equal
    monkeypatch.setattr(suffix_dedup, "prefix_hash", lambda v: np.concatenate((np.zeros(1, np.uint64), np.cumsum(v.astype(np.uint64)))))
    monkeypatch.setattr(suffix_dedup, "powers", lambda b, n: np.ones(n, np.uint64))
    data = np.frombuffer(b"abcd" b"dcba" b"abcd" b"bacd" b"dcba" b"zzzz", np.uint8)
    at, group = np.array([0, 4, 8, 12, 16, 20]), np.array([0, 0, 0, 0, 0, 0])
    order, label = suffix_dedup.classes(data, at, group, 4)
    found = {}
    for i, c in zip(order.tolist(), label.tolist(), strict=True):
        found.setdefault(c, set()).add(int(at[i]))
    assert sorted(map(sorted, found.values())) == [[0, 8], [4, 16], [12], [20]]


def test_merge_sort_is_lexicographic():
    rnd = np.random.default_rng(3)
    data = rnd.integers(97, 99, 3000).astype(np.uint8)
    at = rnd.integers(0, 2900, 700)
    group = np.sort(rnd.integers(0, 40, 700))
    order = suffix_dedup.Suffixes(data, 100).merge_sort(at, group)
    want = sorted(range(700), key=lambda i: (group[i], data[at[i] : at[i] + 100].tobytes()))
    key = lambda i: (group[i], data[at[i] : at[i] + 100].tobytes())
    assert [key(i) for i in order] == [key(i) for i in want]


def test_repeated_rows_clashing_columns_and_empty_table(spark):
    long = "".join(random.Random(1).choices("abcdefgh", k=300))
    df = spark.createDataFrame([(1, long, 1, "x"), (1, long, 2, "y"), (None, long, 3, "z"), (2, "é" + long[:150], 4, "z"), (3, "", 5, None)], "doc_id bigint, text string, blob int, rest string")
    got = suffix_dedup.dedup(df).select("doc_id", *suffix_dedup.measures()).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in got) == [("1", 0), ("1", 300), ("2", 150), ("3", 0), ("None", 300)]
    kept = suffix_dedup.dedup_documents(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text, r.rest) for r in kept.collect() if r.doc_id != 1) == [(2, "é", "z"), (3, "", None)]
    assert suffix_dedup.dedup(df.limit(0)).count() == 0 and suffix_dedup.dedup_documents(df.limit(0)).count() == 0


def test_anchors_do_not_depend_on_pieces(monkeypatch):
    rnd = np.random.default_rng(4)
    texts = _bytes.Texts(rnd.integers(97, 100, 5000).astype(np.uint8), np.array([0, 0, 40, 1500, 1599, 1700, 5000]))
    want = suffix_dedup.anchors(texts)
    monkeypatch.setattr(suffix_dedup, "PIECE", 77)
    for a, b in zip(want, suffix_dedup.anchors(texts), strict=True):
        assert (a == b).all()
