import random

import numpy as np
import pytest
from brute import components, shingles

import __spark_entry__
from lakesieve.llm import _bytes, jaccard_join, quality_rules
from lakesieve.llm.components import components as spark_components

Q = __spark_entry__.queries()


def planted(seed):
    rnd = random.Random(seed)
    text = lambda n: [f"w{rnd.randint(0, 3000)}" for _ in range(n)]
    passage, out = text(70), []
    for n in (1, 2, 4, 5, 6, 8, 9, 10, 12, 17, 25, 40, 80, 200, 500):
        base = text(n)
        for k in range(6):
            words = list(base)
            for _ in range(rnd.randint(0, 1 + n // 25)):
                words[rnd.randrange(len(words))] = f"x{k}{rnd.random()}"
            out.append(" ".join(words))
        out += [" ".join(base[: n - k]) for k in range(min(n, 4))]
        out.append("  ".join(base).upper())
    out += [" ".join(text(10) + passage + text(rnd.randint(0, 20))) for _ in range(80)]
    chain = text(120)
    for k in range(25):  # neighbours are similar, the ends are not
        out.append(" ".join(chain[4 * k :] + [f"c{i}" for i in range(4 * k)]))
    out += ["", None, " \n", "same words here now ok"] * 2
    docs = list(enumerate(out))
    rnd.shuffle(docs)
    return docs


@pytest.mark.parametrize("hot, tokens", [(64, 1 << 20), (3, 1 << 20), (3, 0)])
def test_against_brute_force(spark, sf, tables, monkeypatch, hot, tokens):
    monkeypatch.setattr(_bytes, "CHUNK_BYTES", 4000)
    monkeypatch.setattr(jaccard_join, "HOT", hot)
    monkeypatch.setattr(jaccard_join, "SALT_LINKS", 7)
    monkeypatch.setattr(jaccard_join, "CLUSTER_TOKENS", tokens)
    monkeypatch.setattr(jaccard_join, "STEP_PAIRS", 50)
    docs = planted(hot)
    folder = tables(documents=docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in Q["op7_jaccard_join"](spark, folder).collect()} == components(docs)
    if hot == 64:
        whole = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in Q["op7_jaccard_join"](spark, sf).collect()} == components(whole)


def test_similar_sets_always_share_an_entry():
    rnd = random.Random(2)
    for trial in range(1500):
        n = rnd.choice([1, 2, 3, 4, 5, 6, 7, 9, 10, 14, 15, 22, 33, 60, 150, 400])
        a = {rnd.getrandbits(64) for _ in range(n)}
        b = set(a)
        while True:
            c = set(b)
            c.discard(rnd.choice(sorted(c))) if rnd.random() < 0.5 else c.add(rnd.getrandbits(64))
            if not c or 100 * len(a & c) < 80 * len(a | c):
                break
            b = c
        tokens = np.concatenate([np.sort(np.array(sorted(x), np.uint64)) for x in (a, b)])
        entry, row, sets, *_ = jaccard_join.index(tokens, np.array([len(a), len(b)]))
        owner = sets[row]
        assert set(entry[owner == 0]) & set(entry[owner == 1]), (trial, n)


def test_sets_that_leave_hot_groups_still_meet():
    rnd = random.Random(3)
    for trial in range(1500):
        n = rnd.choice([3, 5, 6, 9, 12, 18, 27, 36, 60, 150])
        a = {rnd.getrandbits(64) for _ in range(n)}
        b = set(a)
        while True:
            c = set(b)
            c.discard(rnd.choice(sorted(c))) if rnd.random() < 0.5 else c.add(rnd.getrandbits(64))
            if not c or 100 * len(a & c) < 80 * len(a | c):
                break
            b = c
        tokens = np.concatenate([np.sort(np.array(sorted(x), np.uint64)) for x in (a, b)])
        entry, row, sets, band, free = jaccard_join.index(tokens, np.array([len(a), len(b)]))
        hot = {e for e in set(entry.tolist()) if rnd.random() < rnd.choice([0.1, 0.5])}
        met = False
        for x in range(len(sets)):
            for y in range(len(sets)):
                if sets[x] == 0 and sets[y] == 1 and band[x] == band[y]:
                    mine, other = set(entry[row == x].tolist()), set(entry[row == y].tolist())
                    stay = [sum(e & 1 for e in own & hot) >= free[z] for own, z in ((mine, x), (other, y))]
                    met |= any(e not in hot or all(stay) for e in mine & other)
        assert met, (trial, n)


def test_texts_that_make_polynomials_collide():
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    texts = [word, other, " ".join(word), " ".join(other)]
    raw = "".join(texts).encode()
    sets, sizes = jaccard_join.shingle_sets(_bytes.Texts(np.frombuffer(raw, np.uint8), np.cumsum([0, *map(len, texts)])))
    assert sets[0] != sets[1] and sizes.tolist() == [len(shingles(t)) for t in texts]
    one = quality_rules.measure(_bytes.Texts(np.frombuffer(f"{word}\n{other}".encode(), np.uint8), np.array([0, 2 * len(word) + 1])))
    assert one["n_dup_lines"][0] == 0


def test_families_of_copies_apart_from_each_other(spark, tables, monkeypatch):
    rnd = random.Random(5)
    monkeypatch.setattr(_bytes, "CHUNK_BYTES", 20_000)
    monkeypatch.setattr(jaccard_join, "STEP_PAIRS", 300)
    base, docs = [f"w{rnd.randint(0, 5000)}" for _ in range(150)], []
    for i in range(400):
        words = list(base)
        for _ in range(rnd.randint(0, 8)):
            words[rnd.randrange(len(words))] = f"w{rnd.randint(0, 400)}"
        docs.append((i, " ".join(words)))
    want = components(docs)
    for tokens in (1 << 20, 1000):
        monkeypatch.setattr(jaccard_join, "CLUSTER_TOKENS", tokens)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in Q["op7_jaccard_join"](spark, tables(documents=docs)).collect()}
        assert got == want


def test_entries_stay_few():
    rnd = np.random.default_rng(1)
    sizes = rnd.integers(20, 900, 300)
    entry, *_ = jaccard_join.index(rnd.integers(0, 1 << 63, int(sizes.sum()), np.uint64), sizes)
    assert len(entry) < 0.75 * sizes.sum()


def test_odd_rows(spark):
    same = "one two three four five six"
    df = spark.createDataFrame([(3, same, 1), (2, same, 2), (None, same, 3), (2, "other words", 4), (9, None, 5)], "doc_id bigint, text string, Component int")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.classes(df).collect()), key=str)
    assert got == [(2, 1, 2), (2, 2, 2), (3, 2, 2), (9, 0, 9), (None, 2, None)]
    kept = jaccard_join.one_of_each(df)
    assert kept.columns == df.columns and sorted(r.Component for r in kept.collect()) == [2, 3, 4, 5]
    assert jaccard_join.classes(df.limit(0)).count() == 0
    assert shingles("a b") == {("a", "b")}


def test_components_of_chains_hubs_and_loops(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 180)] + [(500, i) for i in range(300, 400)] + [(7, 7)] + [(i, 1000 - i) for i in range(200, 260)]
    rnd.shuffle(edges)
    got = {r.id: r.component for r in spark_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    boss = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            boss[a] = boss[b] = min(boss[a], boss[b])
    assert got == {k: v for k, v in boss.items() if k != 7}
    assert spark_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
