"""Files, columns and chats as samples, and what is written of them."""

import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lakesieve.functions.text import BLANKS, clean, collapsed
from lakesieve.sources import files, imports
from lakesieve.sources.samples import extract, sample_text, with_derived
from lakesieve.store import positions

CONVERTED = [".gitattributes", "main/test/0000.parquet", "main/train/0000.parquet", "socratic/test/0000.parquet", "socratic/train/0000.parquet"]


def test_selection():
    assert files.configs(CONVERTED) == ["main", "socratic"] and files.splits(CONVERTED, "main") == ["test", "train"]
    assert files.converted_files(CONVERTED, "main", "train") == ["main/train/0000.parquet"] and files.converted_files(CONVERTED, "main", "validation") == []
    assert files.converted_files(["c/partial-train/0.parquet"], "c", "train") == ["c/partial-train/0.parquet"] and files.splits(["c/partial-train/0.parquet"], "c") == ["train"]
    flat = ["cfg/train-00000-of-00002.parquet", "cfg/train-00001-of-00002.parquet", "cfg/test.parquet", "cfg/train_sft-0.parquet"]
    assert files.converted_files(flat, "cfg", "train") == flat[:2] and files.splits(flat, "cfg") == ["train", "test", "train_sft"]
    for names, card, want in ((["default"], [], "default"), (["main", "socratic"], [("main", False)], "main"), (["a", "b"], [("a", False), ("b", True)], "b"), ([], [], "default"), (["x", "y"], [], "x"), ([], [("p", False), ("q", True)], "q")):
        assert files.default_config(names, card) == want
    own = ["README.md", "data/test-0-of-1.parquet", "data/train-0-of-1.parquet", "data/train_sft-0-of-1.parquet", "data/.train.parquet"]
    assert files.main_files(own, "default", "train") == own[2:3] and files.main_files(own, "default", "train_sft") == own[3:4]
    assert files.main_files(["README.md", "all.jsonl"], "default", "train") == ["all.jsonl"] and files.main_files(["README.md", "all.jsonl"], "default", "test") == []
    assert files.main_files(["a/train-0.parquet", "b/train-0.parquet"], "a", "train") == ["a/train-0.parquet"]
    assert files.main_files(["train.json", "train.parquet"], "default", "train") == ["train.parquet"]
    assert files.resolve(["train.json"], "default", "train", CONVERTED).config == "main"
    assert files.resolve(["main/dev.jsonl"], "main", "dev", CONVERTED) == files.Source("main", ("main/dev.jsonl",), False)
    for bad in ((["x.txt"], "default", "train", None), (["x.txt"], "none", "train", CONVERTED), (["x.txt"], "main", "dev", CONVERTED)):
        with pytest.raises(files.SourceError):
            files.resolve(*bad)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_reading(spark, tmp_path):
    bodies = {"a.json": '[{"p": 1}, 5, {"p": 2}]', "b.json": '{"n": 3, "z": [{"p": 3}, {"p": 4}], "d": [{"q": 1}]}', "c.json": '{"p": 5}', "d.json": '{"p": 6}\n{"p": 7}\n\n', "e.jsonl": '{"p": 8}\n\n{"p": 9}\n'}
    for name, body in bodies.items():
        (tmp_path / name).write_text(body)
    got = {name: sorted(r.p for r in files.read(spark, str(tmp_path / name)).collect()) for name in bodies}
    assert got == {"a.json": [1, 2], "b.json": [3, 4], "c.json": [5], "d.json": [6, 7], "e.jsonl": [8, 9]}


def test_cleaning(spark):
    texts = [None, "  a b \n", "x\0y", BLANKS + "m" + BLANKS + "n" + BLANKS, "é　 ü", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(clean(F.col("t")).alias("c"), collapsed(F.coalesce("t", F.lit(""))).alias("o"))
    want = [((t or "").replace("\0", "").strip(), " ".join((t or "").split())) for t in texts]
    assert rows(df) == want
    odd = spark.createDataFrame([(42, bytearray(b"by\xff"), ["x", "y"], True)], "i int, b binary, l array<string>, t boolean")
    assert rows(odd.select(*(clean(F.col(f.name), f.dataType) for f in odd.schema))) == [("42", "by�", '["x","y"]', "True")]


CHATS = [
    [("system", "Be terse."), ("user", " Hi "), ("assistant", "Hello!"), ("user", "again"), ("assistant", "second")],
    [("human", "Q?"), ("gpt", "A.")], [("assistant", "greeting"), ("User", "q")], None, [], [("user", "a"), ("system", "late"), ("bot", "b")],
]
WANT = [("Hi", "Be terse.", "Hello!"), ("Q?", None, "A."), ("q", None, ""), ("", None, ""), ("", None, ""), ("a", None, "b")]


@pytest.mark.parametrize("form", ["role content", "from value", "json", "parts", "json parts"])
def test_chats(spark, form):
    one, two = ("from", "value") if form == "from value" else ("role", "content")
    if form.startswith("json"):
        body = (lambda t: [{"type": "text", "text": t}]) if "parts" in form else (lambda t: t)
        df = spark.createDataFrame([(None if c is None else json.dumps([{one: r, two: body(t)} for r, t in c]),) for c in CHATS], "messages string")
    elif form == "parts":
        df = spark.createDataFrame([(None if c is None else [(r, [("text", t), ("image", None)]) for r, t in c],) for c in CHATS], "messages array<struct<role:string,content:array<struct<type:string,text:string>>>>")
    else:
        df = spark.createDataFrame([(c,) for c in CHATS], f"messages array<struct<`{one}`:string,`{two}`:string>>")
    got = extract(df, {"messages": "messages"}).select(F.lit(1).alias("id"), F.lit(1).alias("dataset_id"), "*")
    assert [(r.prompt, r.context, r.response) for r in with_derived(got).collect()] == WANT


def test_mappings(spark):
    df = spark.createDataFrame([("i", "", "o", 1, "not json"), ("j", "c", "p", 7, '[{"role": "user", "content": "u"}]')], "a string, b string, c string, label bigint, m string")
    assert rows(extract(df, {"prompt": "a", "context": "b", "response": "c", "category": "label"}, {"label": ["no", "yes"]})) == [("i", "", "o", "yes"), ("j", "c", "p", "7")]
    assert [r.prompt for r in extract(df, {"messages": "m"}).collect()] == ["not json", "u"]
    assert [r.prompt for r in extract(df, {"messages": "m", "prompt": "a"}).collect()] == ["i", "j"]
    assert rows(df.select(F.lit(" p ").alias("prompt"), F.lit("r" * 3000).alias("response")).select(F.length(sample_text())).distinct()) == [(2000,)]


def test_import(spark, tmp_path):
    meta = {"info": {"features": {"label": {"names": ["neg", "pos"], "_type": "ClassLabel"}, "question": {"_type": "Value"}}}}
    for k in range(3):
        table = pa.table({"question": [f"q{k}-{i}" for i in range(40)], "answer": [f"a{i}" for i in range(40)], "label": [i % 3 for i in range(40)], "unused": ["x"] * 40})
        (tmp_path / "data").mkdir(exist_ok=True)
        pq.write_table(table.replace_schema_metadata({"huggingface": json.dumps(meta)}), tmp_path / "data" / f"train-{k}-of-3.parquet", row_group_size=7)
    got = imports.import_dataset(spark, str(tmp_path), dataset_id=3, max_samples=50)
    samples = sorted(got.samples.collect(), key=lambda r: r.sample_index)
    assert got.total == 120 and got.fields == {"prompt": "question", "response": "answer", "category": "label"}
    assert [r.sample_index for r in samples] == list(range(50)) and [r.prompt for r in samples] == [f"q{i // 40}-{i % 40}" for i in range(50)]
    assert [r.category for r in samples[:4]] == ["neg", "pos", "2", "neg"] and {r.dataset_id for r in samples} == {3} and len({r.id for r in samples}) == 50
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "all.jsonl").write_text("".join(json.dumps({"prompt": f"p{i}", "response": "r"}) + "\n" for i in range(30)))
    more = imports.import_dataset(spark, str(tmp_path / "lines"), dataset_id=4).samples
    assert [r.prompt for r in more.orderBy("sample_index").collect()] == [f"p{i}" for i in range(30)]
    path = str(tmp_path / "table")
    imports.append_dataset(got.samples, path)
    imports.append_dataset(more, path)
    imports.append_dataset(more, path)
    count = lambda: {r.dataset_id: r["count"] for r in spark.read.parquet(path).groupBy("dataset_id").count().collect()}
    assert count() == {3: 50, 4: 30}
    assert imports.delete_dataset(spark, path, 3) and not imports.delete_dataset(spark, path, 3)
    assert count() == {4: 30}
    with pytest.raises(ValueError):
        imports.import_dataset(spark, str(tmp_path), split="test")


def test_positions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    assert sorted(rows(positions(df, ["x"]))) == [(i, i) for i in range(1000)]
    assert positions(df.limit(0), ["x"]).count() == 0
