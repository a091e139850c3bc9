import math
import zlib
from collections import Counter, defaultdict

import pytest
from brute import WORDS, lower

import __spark_entry__
from lakesieve.llm import _bytes, lm_scoring

Q = __spark_entry__.queries()


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 1


def base(docs):
    tokens = {i: [*WORDS.findall(lower(t)), None] for i, t in docs}
    c = Counter(w for i, ws in tokens.items() if not held_out(i) for w in ws)
    n, v = sum(c.values()), len(c)
    return {i: (held_out(i), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for i, ws in tokens.items()}


def weighted(docs, depth):
    """Context-tree weighting with dictionaries, one bit at a time."""
    ones, every, children = Counter(), Counter(), defaultdict(set)
    streams = {i: b" ".join(lower(t).encode().split()) + b"\xff" for i, t in docs}

    def bits(raw):
        for at, byte in enumerate(raw):
            before = (b"\xff" * depth + raw[:at])[-depth:]
            for b in range(8):
                yield before, (1 << b) | byte >> (8 - b), byte >> (7 - b) & 1

    for i, raw in streams.items():
        if not held_out(i):
            for before, node, bit in bits(raw):
                for d in range(depth + 1):
                    key = before[depth - d :], node
                    ones[key] += bit
                    every[key] += 1
                    if d:
                        children[before[depth - d + 1 :], node].add(key)

    def kt(key):
        a, n = ones[key], every[key]
        return math.lgamma(a + 0.5) + math.lgamma(n - a + 0.5) - math.lgamma(n + 1) - math.log(math.pi)

    logs: dict = {}
    for key in sorted(every, key=lambda k: -len(k[0])):
        logs[key] = kt(key)
        if len(key[0]) < depth:
            deep = sum(logs[k] for k in children[key])
            hi = max(kt(key), deep)
            logs[key] = hi + math.log(math.exp(kt(key) - hi) + math.exp(deep - hi)) - math.log(2)
    out = {}
    for i, raw in streams.items():
        total = 0.0
        for before, node, bit in bits(raw):
            path = [(before[depth - d :], node) for d in range(depth + 1)]
            seen = [k for k in path if k in every]
            kts = [(ones[k] + 0.5) / (every[k] + 1) for k in seen]
            p = kts[-1] if seen else 0.5
            for k, own in list(zip(seen, kts, strict=True))[-2::-1]:
                w = math.exp(kt(k) - math.log(2) - logs[k])
                p = w * own + (1 - w) * p
            total += math.log10(p if bit else 1 - p)
        out[i] = total
    return out


def test_against_brute_force(spark, sf, tables, monkeypatch):
    monkeypatch.setattr(_bytes, "CHUNK_BYTES", 20_000)
    monkeypatch.setattr(lm_scoring, "RUN_KEYS", 3000)
    whole = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    odd = [(i, t) for i, (_, t) in enumerate(whole[:40])] + [(100, ""), (101, None), (102, "Ünseen 中文 words\n\nhere"), (103, "a"), (104, " a\tA ")]
    for docs, folder in ((whole, sf), (odd, tables(documents=odd))):
        got = {r.doc_id: r for r in Q["op10_lm_scoring"](spark, folder).collect()}
        want = base(docs)
        assert got.keys() == want.keys()
        for i, (held, n, known, total, score) in want.items():
            r = got[i]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
            assert r.base_score == pytest.approx(score, rel=1e-9)
        for i, score in weighted(docs, lm_scoring.DEPTH).items():
            assert got[i].score == pytest.approx(score, rel=2e-6, abs=1e-5)


def test_held_out_texts_take_fewer_bits_than_under_the_base(spark):
    got = Q["op10_lm_scoring"](spark, "/root/testdata/sf0.1").where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert got["sum(score)"] > 0.97 * got["sum(base_score)"]


def test_repeated_rows_without_id_and_no_rows(spark):
    df = spark.createDataFrame([(None, "a b", 1), (2, "a b", 2), (2, "a b", 3)], "doc_id bigint, text string, score int")
    assert [r.n_tokens for r in lm_scoring.score(df).collect()] == [3, 3, 3]
    assert lm_scoring.score(df.limit(0)).count() == 0


def test_a_very_long_text_is_scored_whole(spark):
    long = "some words of a long text " * 120_000
    df = spark.createDataFrame([(2, long), (3, "some words"), (4, None)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in lm_scoring.score(df).collect()}
    assert got[2].n_tokens == 6 * 120_000 + 1 and got[4].n_tokens == 1
    assert 0 < got[2].bits_per_symbol < 0.1 and got[2].score < 0
