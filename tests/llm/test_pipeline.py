import pytest
from brute import WORDS, components, leaks, quality, repeats, targets

import corpus_pipeline
from lakesieve.llm import quality_rules


def kept_bytes(docs):
    """{doc_id: text without repeated passages}; documents of which nothing is left are missing."""
    seen, out = set(), {}
    for i, text in sorted(docs.items()):
        raw = text.encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            w = raw[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(w)
        rest = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        assert (len(raw), sum(gone)) == repeats([(i, text)])[i][:1] + (sum(gone),)
        if rest or not raw:
            out[i] = rest.decode("utf-8", "ignore")
    return out


def test_run_against_brute_force(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rejected = {r.doc_id for r in quality_rules.ledger(spark.read.parquet(f"{sf}/documents.parquet")).where(~quality_rules.passes("web-1")).collect()}
    assert {i for i, d in docs.items() if quality(d.text)[-1]} <= rejected
    left = {i: d.text for i, d in docs.items() if i not in rejected}
    of = components(left.items())
    left = kept_bytes({i: t for i, t in left.items() if of[i][1] == i})
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = {i: t for i, t in left.items() if not leaks(t, items)[-1]}
    got = corpus_pipeline.run(spark, sf).collect()
    sizes: dict = {}
    for i, t in left.items():
        sizes[docs[i].source] = sizes.get(docs[i].source, 0) + len(WORDS.findall(t))
    want, taken = targets(sizes), {}
    for r in got:
        assert left[r.doc_id] == r.text and r.n_chars == len(r.text) and (r.lang, r.source) == (docs[r.doc_id].lang, docs[r.doc_id].source)
        taken[r.source] = taken.get(r.source, 0) + len(WORDS.findall(r.text))
    longest = max(len(WORDS.findall(t)) for t in left.values())
    assert len({(r.doc_id, r.copy) for r in got}) == len(got)
    for s, t in want.items():
        assert taken.get(s, 0) == pytest.approx(t, abs=longest / 2 + 1)


def test_stages_pass_columns_on(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(20)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_odd_rows_pass_every_stage(spark, tables):
    import random

    rnd = random.Random(4)
    text = lambda n: " ".join(f"w{rnd.randint(0, 4000)}" for _ in range(n))
    same, passage = text(80), text(40)
    rows = [(1, same), (2, same), (2, same), (None, text(60)), (None, text(60)), (3, None), (4, ""), (5, " \n"), (6, text(30_000)), (7, text(50) + " " + passage), (8, passage + " " + text(50)), (9, "x " * 400)]
    rows = [(i, t, "en", "s" if k % 2 else None, None if t is None else len(t), k, 0) for k, (i, t) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, copy int, Size int")
    folder = tables(benchmark=[(1, "an item of the benchmark that nobody has")])
    for name, stage in corpus_pipeline.STAGES:
        new = stage(spark, docs, folder)
        if stage is corpus_pipeline.mixed:
            assert new.columns == [*docs.columns, "_copy"]
        else:
            assert new.columns == docs.columns, name
        docs = corpus_pipeline.cut(new, "odd")
    kept = [r.doc_id for r in docs.collect()]
    assert {i for i in kept if i is not None} <= {1, 6, 7, 8} and kept
