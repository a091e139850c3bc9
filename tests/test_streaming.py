import json

from lakesieve.streaming.ingest import ingest


def test_files_that_arrive(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    schema = spark.createDataFrame([], "n bigint, instruction string, output string").schema

    def arrive(name, rows):
        (source / name).write_text("".join(json.dumps({"n": n, "instruction": p, "output": r}) + "\n" for n, p, r in rows))
        ingest(spark, str(source), schema, out, str(tmp_path / "check"), "n", distinct=True, checks=True).awaitTermination(120)

    arrive("a.json", [(1, "q", "a reply of several words"), (2, "q2", "me@site.org is my address")])
    arrive("b.json", [(3, "Q", "a  reply of several words"), (4, "q4", "")])
    got = {r.id: r for r in spark.read.parquet(out).collect()}
    assert sorted(got) == [1, 2, 4] and (got[2].pii, got[4].empty_or_short, got[1].lang) == ("warn", "fail", "en")
