import re

import pytest
from brute import WORDS, leaks, quality, targets

import __spark_entry__
from lakesieve.llm import decontamination, mixing, quality_rules, url_filters, warc

Q = __spark_entry__.queries()
ODD = ["", None, " \n\t", "a b\n a b\na b\n\n\na b", "x " * 50, "é ü\x0b#*$ %&|<>", "one two three four five six seven eight " * 3 + "nine", "A" * 70000, "\u3000a\xa0b c\x85d"]


def test_quality_rules_against_brute_force(spark, sf, tables):
    for folder in (sf, tables(documents=list(enumerate(ODD)) + [(0, "x " * 50), (None, "x")])):
        docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
        want = sorted(((d.doc_id, *quality(d.text)) for d in docs), key=str)
        got = Q["op4_quality_rules"](spark, folder)
        assert sorted((tuple(r) for r in got.drop("kept", "failed_bits").collect()), key=str) == want
        assert not got.where("base_failed and kept").count()


def test_quality_policies_and_ablations(spark, tables):
    folder = tables(documents=[(1, "few words"), (2, "a b c d e f g h " * 9), (3, " ".join(f"word{i}" for i in range(40)))])
    entries = quality_rules.ledger(spark.read.parquet(f"{folder}/documents.parquet"))
    assert [r.doc_id for r in entries.where(quality_rules.passes("base-1")).collect()] == [3]
    ablated = {r.rule: (r.n_docs, r.n_failed, r.n_only) for r in quality_rules.ablations(entries, "base-1").collect()}
    assert ablated == {"few_words": (3, 1, 1), "repeated_words": (3, 1, 1)}
    clash = spark.createDataFrame([(1, "a", 7, 8)], "doc_id int, text string, n_words int, Failed_Bits int")
    assert quality_rules.ledger(clash).columns[:4] == clash.columns and quality_rules.filter_documents(clash).columns == clash.columns
    assert quality_rules.ledger(clash.limit(0)).count() == 0


def test_decontamination_against_brute_force(spark, sf, tables):
    long = " ".join(f"w{i}" for i in range(30))
    own = tables(documents=[(1, long.upper() + "!"), (2, "tiny Item, here"), (3, None), (4, ""), (5, "w0 " + long[3:60]), (5, "w0 tiny-item_here")], benchmark=[(7, long), (8, "tiny item here"), (9, None), (10, "..."), (7, long), (11, long)])
    for folder in (sf, own):
        items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
        docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
        want = sorted(((d.doc_id, *leaks(d.text, items)) for d in docs), key=str)
        assert sorted((tuple(r) for r in Q["op6_decontamination"](spark, folder).collect()), key=str) == want


def test_decontamination_spans_blocks_and_empty_tables(spark, monkeypatch):
    docs = spark.createDataFrame([("é, ONE two.  Three x", 1, 2), (None, 3, 4)], "text string, n_words int, Hit_Items int")
    items = spark.createDataFrame([(1, "one two three"), (2, "two three x")], "item_id int, text string")
    for size in (1, 1 << 20):
        monkeypatch.setattr(decontamination, "BLOCK_WINDOWS", size)
        a, b = decontamination.scan(docs, items, keep=["n_words", "Hit_Items"]).orderBy("n_words").collect()
        assert a._n_words == 5 and a.hit_words == [1, 2, 3, 4] and a._hit_items == ["1", "2"]
        assert [b"\xc3\xa9, ONE two.  Three x"[s:e] for s, e in a.hit_spans] == [b"ONE two.  Three x"]
        assert b.hit_words == [] and b._n_words == 0
    assert decontamination.filter_documents(docs, items).columns == docs.columns
    assert decontamination.scan(docs, items.limit(0)).where("size(hit_words) > 0").count() == 0
    assert decontamination.scan(docs.limit(0), items).count() == 0


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest, re.S).groups()
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def verdict(url, rules=url_filters.PATTERN_RULES):
    host, path = host_path(url)
    fits = [r for r in url_filters.HOST_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    own = "block" if any(re.search(r.pattern, url or "") for r in rules) else "allow"
    return host, path, best and best.name, best.verdict if best else own


@pytest.mark.parametrize("inline", [20_000, 0])
def test_urls_against_brute_force(spark, sf, tables, monkeypatch, inline):
    monkeypatch.setattr(url_filters, "MAX_INLINE", inline)
    odd = [None, "", "no scheme", "http://", "HTTP://A.NET", "x://EXAMPLE.net/en/1", "http://notexample.net/en/", "a://b://c.org/fr/x", "http://org/fr/?q", "http://x.org?fr/#/", "https://q.de/?utm_source=feed", "http://q.de/login.php?x", "http://example.com/de", "http://Émile.NET/é\n/x?y", "http://ads.q.de/", "http://q.de/a.zip#b"]
    for folder in (sf, tables(pages=[(i, u, "") for i, u in enumerate(odd)] + [(0, "http://q.net/"), (None, "http://q.net/")])):
        pages = spark.read.parquet(f"{folder}/pages.parquet").collect()
        want = sorted(((p.page_id, *verdict(p.url)) for p in pages), key=str)
        assert sorted((tuple(r) for r in Q["op5_url_filters"](spark, folder).collect()), key=str) == want


def test_urls_names_and_rules_without_tokens(spark):
    df = spark.createDataFrame([(1, "http://a.b/c", "x"), (2, None, "y")], "host int, url string, Verdict string")
    got = url_filters.judge(df, pattern_rules=[url_filters.PatternRule("a\\.b", ())])
    assert got.columns == ["host", "url", "Verdict", "_host", "path", "rule", "_verdict"]
    assert [r._verdict for r in got.orderBy("host").collect()] == ["block", "allow"]
    assert url_filters.judge(df.limit(0), host_rules=(), pattern_rules=()).count() == 0


def test_url_rules_from_a_file(spark, tmp_path):
    (tmp_path / "rules").write_text("# remark\nblock\tnet/\nallow\texample.net/en/\n\npattern\t//ads\\.\tads\n")
    hosts, patterns = url_filters.read_rules(spark, str(tmp_path / "rules"))
    assert hosts == [url_filters.HostRule("net", "/", "block"), url_filters.HostRule("example.net", "/en/", "allow")] and patterns == [url_filters.PatternRule("//ads\\.", ("ads",))]
    df = spark.createDataFrame([(1, "http://example.net/en/x"), (2, "http://q.net"), (3, "http://ads.x.de"), (4, None)], "id int, url string")
    assert [r.verdict for r in url_filters.judge(df, host_rules=hosts, pattern_rules=patterns).orderBy("id").collect()] == ["allow", "allow", "block", "allow"]
    (tmp_path / "bad").write_text("deny\tx/")
    with pytest.raises(ValueError):
        url_filters.read_rules(spark, str(tmp_path / "bad"))


def test_mixing_targets_sizes_and_reruns(spark, sf, tables):
    odd = [(i, "w " * (i % 7), None, ("a", "b", None, "Z")[i % 4]) for i in range(400)] + [(None, "x", None, "a"), (1, None, None, "empty"), (3, "w w w", None, "Z")]
    for folder in (sf, tables(documents=odd)):
        docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
        sizes: dict = {}
        for d in docs:
            sizes[d.source] = sizes.get(d.source, 0) + len(WORDS.findall(d.text or ""))
        want = targets(sizes)
        got = Q["op8_mixing"](spark, folder).collect()
        assert sorted(map(str, got)) == sorted(map(str, Q["op8_mixing"](spark, folder).collect()))
        assert sorted((str(g.doc_id), g["size"]) for g in got) == sorted((str(d.doc_id), len(WORDS.findall(d.text or ""))) for d in docs)
        source_of = {d.doc_id: d.source for d in docs if [x.doc_id for x in docs].count(d.doc_id) == 1}
        taken: dict = {}
        largest: dict = {}
        for g in got:
            assert 0 <= g.taken <= 3 * g["size"]
            if g.doc_id in source_of:
                s = source_of[g.doc_id]
                assert g.source_size == sizes[s] and g.target == pytest.approx(want[s])
                taken[s] = taken.get(s, 0) + g.taken
                largest[s] = max(largest.get(s, 0), g["size"])
        if folder == sf:
            for s, t in taken.items():
                assert abs(t - want[s]) <= largest[s] / 2 + 1


def test_mixing_documents(spark, tables):
    df = spark.createDataFrame([(i, "a b c", "s" + str(i % 3), i) for i in range(300)], "doc_id int, text string, source string, size int")
    mixed = mixing.mix_documents(df)
    assert mixed.columns == [*df.columns, "copy"]
    counts = {r.source: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert counts == {"s0": 50, "s1": 100, "s2": 150}
    assert mixing.mix_documents(df.limit(0)).count() == 0
    # two ids, each in 200 equal rows, and a source that can be copied
    many = spark.createDataFrame([(i % 2, "a b c d", "s", 1) for i in range(400)] + [(9, "w " * 4800, "t", 1)], "doc_id int, text string, source string, rank int")
    taken = {r.source: r["count"] for r in mixing.mix_documents(many).groupBy("source").count().collect()}
    want = targets({"s": 1600, "t": 4800})
    assert taken["s"] * 4 == pytest.approx(want["s"], abs=2) and taken["t"] == 1


def pareto(rows, cap=3):
    """Copies by the plain definition: expected copies by weight, whole parts for certain, the rest in order of the odds."""
    import hashlib
    import math

    out: dict = {}
    sizes: dict = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    for s, target in targets(sizes).items():
        own, seen = [], {}
        for i, _, n in (r for r in rows if r[1] == s):
            k = seen[i, n] = seen.get((i, n), -1) + 1
            own.append((i, n, k, 2 ** (math.floor(64 * math.log2(math.log2(n + 2)) + 0.5) / 64)))
        full: set = set()
        while True:
            left = target - sum(cap * n for i, n, k, w in own if (i, n, k) in full)
            scale = left / (sum(w * n for i, n, k, w in own if (i, n, k) not in full) or 1)
            more = {(i, n, k) for i, n, k, w in own if (i, n, k) not in full and scale * w >= cap * (1 - 1e-12)}
            if not more:
                break
            full |= more
        room, order = target, []
        for i, n, k, w in own:
            e = cap if (i, n, k) in full else scale * w if n else 0
            out[i, s, n, k] = math.floor(e)
            room -= math.floor(e) * n
            key = ":".join([mixing.SEED, "" if i is None else str(i), s or "", str(n), str(k)])
            u = (int(hashlib.md5(key.encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            if (p := e - math.floor(e)) > 0:
                order.append(((u / (1 - u)) / (p / (1 - p)), n, (i, s, n, k)))
        ahead = 0
        for _, n, key in sorted(order, key=lambda o: o[0]):
            out[key] += ahead + n / 2 <= room
            ahead += n
    return out


@pytest.mark.parametrize("bits", [12, 2])
def test_mixing_takes_the_documents_of_the_plain_definition(spark, tables, monkeypatch, bits):
    import random

    rnd = random.Random(bits)
    monkeypatch.setattr(mixing, "BIN_BITS", bits)
    monkeypatch.setattr(mixing, "RUN", 3)
    rows = [(rnd.randint(0, 250), rnd.choice(["a", "b", "c", "d", None]), rnd.choice([0, 1, 2, 5, 9, 40, 300])) for _ in range(500)] + [(None, "a", 3)] * 40
    folder = tables(documents=[(i, "w " * n, None, s) for i, s, n in rows])
    want = sorted((str(i), n, c * n) for (i, s, n, k), c in pareto(rows).items())
    assert sorted((str(r.doc_id), r["size"], r.taken) for r in Q["op8_mixing"](spark, folder).collect()) == want
    odds = [c for (i, s, n, k), c in pareto(rows).items() if n]
    assert len(set(odds)) > 2


def want_warc(pages):
    import base64
    import hashlib

    best: dict = {}
    for p in pages:
        if p.page_id is not None:
            best[p.html or ""] = max(best.get(p.html or "", p.page_id), p.page_id)
    out = []
    for p in pages:
        raw = (p.html or "").encode()
        last = best.get(p.html or "", p.page_id)
        again = p.page_id is not None and p.page_id != last
        out.append((p.page_id, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", last if again else None))
    return sorted(out, key=str)


def test_warc_round_trip(spark, sf, tables, monkeypatch):
    odd = ["", None, "a\r\n\r\nb", "\r\n\r\nWARC/1.1\r\n\r\n", "é" * 50_000, "é" * 50_000, "\n", "x" * 65536, "x" * 65537, "\r\n\r\n", "end\r\n", "\x00", "a\rb"]
    own = [(i, f"http://x/{i} é\n", h) for i, h in enumerate(odd)] + [(2, "u", "a\r\n\r\nb"), (2, "u", "other"), (None, None, "lonely"), (None, None, "")]
    for folder in (sf, tables(pages=own), tables()):
        pages = spark.read.parquet(f"{folder}/pages.parquet").collect()
        got = Q["op2_warc"](spark, folder)
        assert sorted((tuple(r) for r in got.collect()), key=str) == want_warc(pages)
    path = warc.archive_folder(spark)
    folder = tables(pages=own)
    warc.write_archives(spark.read.parquet(f"{folder}/pages.parquet"), path, chunk=7)
    whole: dict = {}
    for r in warc.read_archives(spark, path).where("record_type = 'response'").orderBy("record_id", "chunk").collect():
        whole[r.record_id] = whole.get(r.record_id, b"") + bytes(r.payload)
    assert whole["3"] == odd[3].encode() and whole["5"] == odd[5].encode() and whole["11"] == b"\0"
