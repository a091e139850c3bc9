"""Every query with SQL beside it against DuckDB, and rules on planted samples."""

import os
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from lakesieve.functions.text import like_pattern  # noqa: E402
from lakesieve.operators import near, pii, quality, search  # noqa: E402
from lakesieve.plans.oracles import ORACLES
from lakesieve.plans.queries import QUERIES  # noqa: E402
from lakesieve.sources.fields import class_label, detect_fields  # noqa: E402
from lakesieve.sources.files import read  # noqa: E402
from lakesieve.sources.samples import from_conversations, with_derived  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    assert got or name in ("missing_vectors_anti", "near_duplicate_pairs", "near_duplicate_lists", "nl_search_quoted")  # may be none at this size
    if name in ORACLES:
        found = duck.execute(ORACLES[name])
        names = [x[0] for x in found.description]
        assert got == sorted((tuple(r[names.index(c)] for c in columns) for r in found.fetchall()), key=str)


def samples(spark, rows):
    return with_derived(spark.createDataFrame([(i, 1, p, None, r, "c") for i, (p, r) in enumerate(rows)], "id bigint, dataset_id bigint, prompt string, context string, response string, category string"))


def test_checks(spark):
    rows = [("q", ""), ("q", "yes it is"), ("q", "a reply of enough words"), ("Q ", "a  reply of enough words"), ("x", "I'm sorry, but I can't help with that request."), ("é", " ".join(["el gato de la casa es una"] * 4))]
    df = samples(spark, rows)
    assert [r.s for r in df.orderBy("id").select(quality.empty_or_short().alias("s")).collect()] == ["fail", "warn", "pass", "pass", "pass", "pass"]
    assert [(r.id, r.duplicate_of) for r in quality.exact_duplicates(df).collect()] == [(3, [2])]
    assert sorted(r.id for r in quality.prompt_conflicts(df).collect()) == [0, 1, 2, 3]
    assert [r.s for r in df.orderBy("id").select(quality.refusal().alias("s")).collect()][4] == "fail"
    assert [r.s for r in df.orderBy("id").select(quality.non_english().alias("s")).collect()] == ["en"] * 5 + ["other"]
    assert {r.id: r.qc_status for r in quality.statuses(quality.qc(df)).collect()}[3] == "fail"


def test_scale_falls_back(spark):
    for tokens, method in (([5] * 8 + [1, 9, 12], "meanabs"), ([5, 5, 5], "constant"), ([1, 2, 3, 9], "mad")):
        df = spark.createDataFrame([(t,) for t in tokens], "tokens_est int")
        assert quality.length_stats(df).first().method == method


def test_counts_patterns_and_chat(spark, tmp_path):
    assert [search.val_count(*x) for x in ((0, 0.1), (1, 0.5), (2, 0.01), (10, 0.25), (10, 0), (3, 0.99))] == [0, 0, 1, 3, 0, 2]
    assert like_pattern(r"a\b\%_") == r"ab\%_"
    turns = [(1, 0, "system", "be kind"), (1, 1, "User", "hi"), (1, 2, "assistant", "hello"), (2, 0, "assistant", "early"), (2, 1, "user", "q"), (3, 0, "assistant", "only")]
    chats = from_conversations(spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string"))
    assert [(r.prompt, r.context, r.response) for r in chats.orderBy("id").collect()] == [("hi", "be kind", "hello"), ("q", None, ""), ("", None, "")]
    (tmp_path / "a.json").write_text('{"data": [{"p": 1}, {"p": 2}]}')
    (tmp_path / "b.jsonl").write_text('{"p": 1}\n{"p": 2}\n{"p": 3}\n')
    assert read(spark, str(tmp_path / "a.json")).count() == 2 and read(spark, str(tmp_path / "b.jsonl")).count() == 3
    assert search.export_lines(chats.where(F.col("id") == 1), "chat").first().line == '{"messages":[{"role":"user","content":"hi\\n\\nbe kind"},{"role":"assistant","content":"hello"}]}'
    with pytest.raises(ValueError):
        search.export_lines(chats, "xml")


def test_pii(spark):
    kinds = {
        "mail me@site.org": ["email"], "key sk-" + "a1" * 12: ["secret"], "pay 4111 1111 1111 1111 now": ["credit_card"], "id 2345 6789 0123": ["aadhaar"],
        "call 555-123-4567": ["phone"], "host 10.20.30.40": ["ip_address"], "version 10.20.30.40": [], "host 0.20.30.40": [], "pay 4111 1111 1111 1112 now": [], "": [],
    }
    for text, expected in kinds.items():
        assert [k for _, _, k in pii.spans_of(text)] == expected, text
    assert pii.spans_of(None) == [] and pii.spans_of("é me@site.org 1234")[0][:2] == (2, 13)
    df = samples(spark, [("q", "me@site.org"), ("q", "a@site.org b@site.org c@site.org"), ("q", "AKIA" + "A" * 16), ("q", "none")])
    assert [r.s for r in df.orderBy("id").select(pii.pii_severity(pii.pii_spans()).alias("s")).collect()] == ["warn", "fail", "fail", "pass"]


def test_near_duplicates(spark):
    base = [f"w{i}" for i in range(120)]
    edit = [*base[:119], "other"]
    half = [*base[:60], *(f"v{i}" for i in range(60))]
    rows = [("q", " ".join(base)), ("q", " ".join(edit)), ("q", " ".join(half)), ("Q", " ".join(base)), ("", ""), ("a b", "")]
    df = samples(spark, rows)
    assert [(r.a, r.b, r.jaccard) for r in near.near_pairs(df).collect()] == [(0, 1, round(116 / 118, 4))]
    assert [(r.id, r.near) for r in near.near_severity(df).collect()] == [(1, "fail")]
    assert near.near_pairs(df.limit(0)).count() == 0


def test_formatting(spark):
    long = " ".join(f"word{i}" for i in range(60))
    rows = {
        "fine.": "", "```py\nx = (1": "unbalanced_code_fence", "```py\nx = (1]\n```": "unbalanced_brackets", "```py\nx = ')' # (\n```": "", "no " + "!" * 20: "repeated_characters",
        "one two three four five six seven eight": "prompt_echo", long + " of": "truncated", long + " see [3": "truncated", long: "", "- " + long + " of": "",
    }
    df = samples(spark, [("one two three four five six seven eight", x) for x in rows])
    got = [",".join(r.i) for r in df.orderBy("id").select(quality.formatting_issues().alias("i")).collect()]
    assert got == list(rows.values())


def test_fields(spark):
    def schema(text):
        return spark.createDataFrame([], text).schema

    assert detect_fields(schema("instruction string, input string, output string, text string")) == {"prompt": "instruction", "context": "input", "response": "output"}
    assert detect_fields(schema("input string, output string")) == {"prompt": "input", "response": "output"}
    assert detect_fields(schema("Prompt string, Completion string, Source string")) == {"prompt": "Prompt", "response": "Completion", "category": "Source"}
    assert detect_fields(schema("prompt string, category string, messages array<struct<role:string,content:string>>")) == {"category": "category", "messages": "messages"}
    assert detect_fields(schema("prompt string, chosen string, label bigint"))["category"] == "label"
    assert detect_fields(schema("q string, a string"), {"prompt": "q", "response": "a", "context": ""}) == {"prompt": "q", "response": "a"}
    for text, told in (("text string, id bigint", None), ("prompt bigint, response string", None), ("q string", {"prompt": "q"}), ("q string", {"prompt": "z", "response": "q"})):
        with pytest.raises(ValueError):
            detect_fields(schema(text), told)
    ids = spark.createDataFrame([(0,), (1,), (7,), (None,)], "c bigint")
    assert [r.n for r in ids.select(class_label(F.col("c"), ["no", "yes"]).alias("n")).collect()] == ["no", "yes", "7", None]
