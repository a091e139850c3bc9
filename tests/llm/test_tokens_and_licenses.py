import math
import random

import pytest

import __spark_entry__
from lakesieve.llm import license_scan, license_texts, token_counts

Q = __spark_entry__.queries()


def tokenizer():
    return token_counts.Coder(token_counts.ranks_of(token_counts.RANKS))


def fresh(by, text):
    """Counts of the whole text, by the tokenizer itself."""
    return sum(len(by.encode(p.encode())) for p in by.cutter.findall(text))


def height(node):
    return 1 if node.counts is not None else 1 + max(height(k) for k in node.kids)


@pytest.mark.parametrize("fan, ahead", [(2, 1), (4, 8), (32, 64)])
def test_edits_give_the_counts_of_the_new_text(monkeypatch, fan, ahead):
    monkeypatch.setattr(token_counts, "FAN", fan)
    monkeypatch.setattr(token_counts, "AHEAD", ahead)
    rnd, by = random.Random(fan), tokenizer()
    bits = ["word", " ", "  ", "\n", "a1", "é", "'s", "12", "!?", " the", "\t ", "@x.y", "'", "ll"]
    for _ in range(150):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 200)))
        held = token_counts.Counted(text, by)
        for _ in range(6):
            a, b = sorted(rnd.randint(0, len(text)) for _ in range(2))
            b = rnd.choice([b, min(b, a + 20)])
            new = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 5)))
            held.edit(a, b, new)
            text = text[:a] + new + text[b:]
            assert held.text == text and list(held.pieces()) == by.cutter.findall(text) and held.total == fresh(by, text)


def test_an_edit_touches_little_of_a_long_text():
    by = tokenizer()
    held = token_counts.Counted("some words of a long text, " * 40_000, by)
    assert height(held.root) <= 4
    for at in (0, 500_000, 1_000_000):
        old = list(held.root.kids)
        held.edit(at, at + 3, "x y")
        assert sum(a is not b for a, b in zip(old, held.root.kids, strict=True)) <= 1
    assert held.recounted < 60


def test_count_query(spark, tables):
    by, long = tokenizer(), "word " * 300_000 + "at 1.2.3.4 end"
    texts = {1: "write to me@x.org or 1.2.3.4 now", 2: None, 3: "", 4: long}
    folder = tables(documents=[*texts.items(), (1, texts[1])])
    got = Q["op9_token_counts"](spark, folder).collect()
    assert len(got) == 5
    for r in got:
        text = texts[r.doc_id] or ""
        after = token_counts.EDITS.sub("[REDACTED]", text)
        assert (r.n_tokens, r.n_edits, r.n_tokens_after) == (fresh(by, text), len(token_counts.EDITS.findall(text)), fresh(by, after))
        assert r.n_recounted < 12
    assert Q["op9_token_counts"](spark, tables()).count() == 0
    clash = spark.createDataFrame([(1, "a b", 7)], "doc_id int, text string, N_Tokens int")
    assert token_counts.count_edited(clash).columns == ["doc_id", "N_Tokens", "_n_tokens", "n_edits", "n_recounted", "n_tokens_after"]


def test_count_query_against_whole_texts(spark, sf):
    by = tokenizer()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in Q["op9_token_counts"](spark, sf).collect():
        text = texts[r.doc_id]
        assert (r.n_tokens, r.n_tokens_after) == (fresh(by, text), fresh(by, token_counts.EDITS.sub("[REDACTED]", text)))


def test_licences(spark, sf):
    apache, mit = license_texts.HEADERS["Apache-2.0"], "MIT License\n\nCopyright (c) 2020 A. Person\n\n" + license_texts.FILES["MIT"]
    wrapped = "/*\n * Permission is hereby granted, free of charge,\n * to any person obtaining\n * a copy of this software\n */\nint main() {}\n" + "more code words here " * 90
    long = "                 Apache License\n           Version 2.0, January 2004\n        http://www.apache.org/licenses/\n\n" + "terms of it " * 2000
    rows = [
        ("a/LICENSE", apache), ("a/b/LICENSE", mit), ("a/x", "plain text"), ("a/b/c/d/y", None), ("z", ""), ("q/y", "code\n# " + apache + ".\n" + "more code words here " * 9), ("q/w", wrapped), (None, "x"),
        ("r/COPYING", long), ("r/z", "x"), ("r/z", "x"), ("s/A", license_texts.FILES["Zlib"]), ("s/B", license_texts.FILES["ISC"]), ("s/x/y", "x"),
    ]
    df = spark.createDataFrame(rows, "path string, text string")
    got = {r.path: (r.licence, r.origin) for r in license_scan.scan(df).collect()}
    assert got == {
        "a/LICENSE": ("Apache-2.0", "file"), "a/b/LICENSE": ("MIT", "file"), "a/x": ("Apache-2.0", "inherited"), "a/b/c/d/y": ("MIT", "inherited"), "z": (None, "none"),
        "q/y": ("Apache-2.0", "header"), "q/w": ("MIT", "header"), None: (None, "none"), "r/COPYING": ("Apache-2.0", "file"), "r/z": ("Apache-2.0", "inherited"),
        "s/A": ("Zlib", "file"), "s/B": ("ISC", "file"), "s/x/y": ("ISC", "inherited"),
    }
    assert license_scan.scan(df).count() == len(rows) and license_scan.scan(df.limit(0)).count() == 0
    clash = spark.createDataFrame([(apache, "a/L", 1, 2, 3, 4)], "text string, path string, Header int, _folder int, given int, licence int")
    assert license_scan.scan(clash).columns == ["path", "Header", "_folder", "given", "licence", "_header", "similarity", "licence_file", "_licence", "origin"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = Q["op3_license_scan"](spark, sf)
    assert found.count() == docs.count()
    assert found.where("header is not null").count() >= docs.where("text like '%Apache License%'").count() > 0


def test_licences_against_brute_force(spark, sf):
    """Every line and block against every template, with dense vectors."""
    docs = [(r.doc_id, r.source, r.lang, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    bodies = [*license_texts.HEADERS.values(), *license_texts.FILES.values(), *license_texts.TITLES.values()]
    words = {t for b in bodies for t in license_scan.tokens(b)}
    df = {t: sum(t in s for s in [set(license_scan.tokens(d[3])) for d in docs]) for t in words}
    idf = {t: math.log((len(docs) + 1) / (n + 1)) + 1 for t, n in df.items()}

    def cosine(a, b):
        x, y = ({t: a.count(t) * idf.get(t, math.log(len(docs) + 1) + 1) for t in set(a)}, {t: b.count(t) * idf[t] for t in set(b)})
        return sum(v * y.get(t, 0) for t, v in x.items()) / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))

    headers = {n: license_scan.tokens(b) for n, b in license_texts.HEADERS.items()}
    got = {r.doc_id: r for r in Q["op3_license_scan"](spark, sf).collect()}
    for i, _, _, text in docs:
        lines = [license_scan.tokens(license_scan.MARKS.sub("", x)) for x in text.split("\n")]
        best = max(((round(cosine(x, h), 6), license_scan.plain(n)) for x in lines if len(x) > 1 and len(set(x) & words) > 1 for n, h in headers.items() if len(x) <= 2 * len(h) + 4), default=(0, None))
        if best[0] >= license_scan.THRESHOLD:
            assert got[i].header == best[1] and got[i].similarity >= best[0]
        elif got[i].header:  # then a block of several lines
            assert any(cosine([t for x in lines[a : a + k] for t in x], headers[n]) >= license_scan.THRESHOLD for n in headers if license_scan.plain(n) == got[i].header for a in range(len(lines)) for k in range(2, 9))
