"""Stored results of checks, dashboards, vectors and exports."""

import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakesieve.operators import export, quality, search, semantic
from lakesieve.operators.search import SampleFilter
from lakesieve.plans import api
from lakesieve.sources.samples import with_derived


def samples(spark, rows, dataset=1):
    return with_derived(spark.createDataFrame([(i, dataset, p, None, r, "c%d" % (i % 2)) for i, (p, r) in enumerate(rows)], "id bigint, dataset_id bigint, prompt string, context string, response string, category string"))


LONG = " ".join(f"word{i}" for i in range(60))


def test_results_have_messages_and_details(spark, tmp_path):
    rows = [("q", LONG + "."), ("Q ", LONG.replace(" ", "  ") + "."), ("q", LONG + " other."), ("", ""), ("ask", "me@site.org and AKIA" + "A" * 16), ("x", "I'm sorry, but I can't help with that."), ("q2", LONG + " more."), ("q3", LONG + " most.")]
    df = samples(spark, rows)
    path = str(tmp_path / "results")
    quality.run_qc(df, path)
    quality.run_qc(df, path)  # replaces
    held = spark.read.parquet(path)
    assert held.count() == 8 * len(rows)
    got = {(r.id, r.check_name): (r.severity, json.loads(r.details), r.message, r.passed) for r in held.collect()}
    assert got[1, "exact_duplicate"][1] == {"duplicate_of": [0], "same_prompt_as": [2]} and got[1, "exact_duplicate"][0] == "fail"
    assert got[0, "exact_duplicate"][:2] == ("warn", {"duplicate_of": [], "same_prompt_as": [2]})
    assert got[2, "near_duplicate"][0] == "fail" and got[2, "near_duplicate"][1]["similar_to"][0]["id"] == 0
    assert got[0, "near_duplicate"][0] == "pass" and "first occurrence" in got[0, "near_duplicate"][2] and len(got[0, "near_duplicate"][1]["similar_to"]) == 3
    assert [x["id"] for x in got[7, "near_duplicate"][1]["similar_to"]] == [0, 2, 6]
    assert got[3, "empty_or_short"][2] == "prompt and response are empty" and got[3, "empty_or_short"][1] == {"prompt_chars": 0, "response_chars": 0}
    assert got[4, "pii"][0] == "fail" and got[4, "pii"][1]["kinds"] == {"email": 1, "secret": 1} and got[4, "pii"][1]["spans"][0]["kind"] == "email"
    assert got[5, "refusal_boilerplate"][0] == "fail" and got[5, "refusal_boilerplate"][1]["phrases"] and not got[5, "refusal_boilerplate"][3]
    assert got[0, "length_outlier"][1] == {"n": 8} and got[0, "non_english"][1]["lang"] == "en" and got[0, "formatting"][1] == {"issues": []}
    done = quality.with_status(df, held)
    assert {r.id: r.qc_status for r in done.collect()}[1] == "fail" and done.where("lang = 'en'").count() == len(rows)
    statuses, checks = api.qc_summary(done, held)
    assert [(r.qc_status, r.n) for r in statuses.collect()][0] == ("pending", 0) and [r.check_name for r in checks.collect()] == list(search.CHECKS)
    own, results, near = api.sample_detail(done, held, 4)
    assert own.first().id == 4 and results.count() == 8 and results.first().severity == "fail" and tuple(near.first()) == (3, 5)
    assert api.nl_search(done, "samples with PII", held)[0].count() == 1


def test_a_failed_run_is_told_of_each_sample(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(quality, "qc", lambda s: 1 / 0)
    got = quality.run_qc(samples(spark, [("a", "b"), ("c", "d")]), str(tmp_path / "r")).collect()
    assert [(r.check_name, r.severity, r.message) for r in got] == [("qc_error", "fail", "ZeroDivisionError: division by zero")] * 2


def test_pages_and_dashboards(spark):
    df = samples(spark, [("p" * 300, f"reply {i}") for i in range(30)])
    page = api.find_samples(df, SampleFilter(category="c0"), limit=5, offset=2).collect()
    assert [r.id for r in page] == [4, 6, 8, 10, 12] and len(page[0].prompt) == 160 and api.count_samples(df, SampleFilter(category="c0")) == 15
    for bad in ({"limit": 0}, {"limit": 501}, {"offset": -1}):
        with pytest.raises(ValueError):
            api.find_samples(df, **bad)
    detail = api.dataset_detail(df)
    assert [r.n for r in detail.statuses.collect()] == [30, 0, 0, 0] and detail.categories.count() == 2 and detail.histogram.count() >= 1
    assert [(r.id, r.prev_id, r.next_id) for r in search.neighbours(df.where("id % 3 = 0")).orderBy("id").limit(2).collect()] == [(0, None, 3), (3, 0, 6)]
    assert [r.category for r in search.categories(df).collect()] == ["c0", "c1"] and search.category_bars(df, 1).collect()[-1].name == "rest"
    with pytest.raises(ValueError):
        api.nl_search(df, "")


def test_vectors(spark):
    df = samples(spark, [(f"about {w}", f"{w} " * 5) for w in ("cats", "dogs", "cats and dogs", "", "fish")])
    first = semantic.embed_dataset(df.where("id < 3"))
    calls = spark.sparkContext.accumulator(0)

    def counted(texts):
        calls.add(len(texts))
        return semantic.embed_words(texts)

    both = semantic.embed_dataset(df, first.unionByName(first.select((F.col("id") + 100).alias("id"), "model", "embedding")), counted)
    assert sorted(r.id for r in both.collect()) == [0, 1, 2, 3, 4] and calls.value == 2
    assert np.allclose([np.linalg.norm(r.embedding) for r in both.collect()], 1, atol=1e-6)
    assert semantic.coverage(df, first).first().asDict() == {"total": 5, "embedded": 3}
    assert [r.id for r in semantic.semantic_search(df, both, "cats", 2).collect()][0] == 0
    assert semantic.similar(both, 0, 2).orderBy("rank").first().id == 2
    with pytest.raises(ValueError):
        semantic.semantic_search(df, both.limit(0), "cats")


@pytest.mark.parametrize("block", [4096, 7])
def test_nearest_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(semantic, "BLOCK", block)
    rng = np.random.default_rng(1)
    x = rng.integers(-2, 3, (60, 4)).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(100, None), (None, [1.0] * 4)], "id bigint, embedding array<double>")
    got = {}
    for r in semantic.nearest(df, df.where("id % 10 = 0").selectExpr("id as query_id", "embedding as vector"), 5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id, r.similarity))
    norm = np.linalg.norm(x, axis=1)
    for q in range(0, 60, 10):
        if not norm[q]:
            assert q not in got
            continue
        sims = [(-round(float(x[q] @ x[i] / norm[q] / norm[i]), 12), i) for i in range(60) if i != q and norm[i]]
        assert sorted(got[q]) == [(k + 1, i, round(-s, 4) + 0.0) for k, (s, i) in enumerate(sorted(sims)[:5])]


def test_exports(spark, tmp_path):
    df = samples(spark, [(f"prompt {i} é", f"reply {i}") for i in range(50)])
    where = SampleFilter(category="c0")
    folder = str(tmp_path / "e")
    manifest = export.build_export(df, folder, where, "jsonl", 0.2, 9, source={"repo": "a/b"})
    assert manifest["counts"] == {"total": 25, "train": 20, "val": 5} and manifest["filter"] == {"category": "c0"}
    name = tmp_path / export.export_filename("a/b c", 9)
    assert name.name == "b_c-export-9.zip"
    export.archive(spark, folder, str(name))
    with zipfile.ZipFile(name) as z:
        assert z.namelist() == ["manifest.json", "train.jsonl", "val.jsonl"] and json.loads(z.read("manifest.json"))["export_id"] == 9
        lines = {n: [json.loads(x) for x in z.read(f"{n}.jsonl").decode().splitlines()] for n in ("train", "val")}
    assert {n: len(x) for n, x in lines.items()} == {"train": 20, "val": 5} and lines["val"][0].keys() == {"prompt", "context", "response", "category"}
    order = [int(x["prompt"].split()[1]) for x in lines["train"]]
    assert order == sorted(order) and export.build_export(df, str(tmp_path / "f"), where, "chat", 0.2, 9)["counts"] == manifest["counts"]
    for bad in ({"where": SampleFilter(category="none")}, {"form": "xml"}, {"ratio": 0.6}):
        with pytest.raises(export.ExportError):
            export.build_export(df, str(tmp_path / "g"), **bad)


@pytest.mark.parametrize("n, ratio", [(0, 0.5), (1, 0.5), (2, 0.1), (1000, 0.1), (1000, 0.0), (337, 0.499)])
def test_split_takes_the_least_ranks(spark, n, ratio):
    import hashlib

    got = {r.id for r in search.split(spark.range(n), ratio, 42).where("split = 'val'").collect()}
    order = sorted(range(n), key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))
    assert got == set(order[: search.val_count(n, ratio)])
