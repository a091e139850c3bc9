"""Licences of files: TF-IDF cosine of headers and whole files to templates, then inheritance from the nearest ancestor directory.

Headers. Lines lose their comment marks; every line, and every block of up to BLOCK_LINES lines that a notice may be wrapped over, is
compared with the header templates. The best cosine from THRESHOLD on is the file's header licence, ties by name.
Licence files. One vector of the whole file is compared with the full texts of short licences, and its first lines with
the titles of long ones. A file that reaches FILE_THRESHOLD, or has such a title, or of which header lines are at least half of all words, is a licence
file: it stands for its directory, and files below without a licence of their own inherit from the nearest directory that
has one, found by joining their ancestor paths. Document frequencies are counted over all files; tokens outside the templates
weigh as if no file had them.

Null and empty texts have no header; texts of any length are read whole, line by line; a null path is the root; where a
directory has several licence files, the first licence by name counts; repeated rows are judged alike; a name that the
other columns have already gets a leading underscore; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesieve.llm._rows import with_measures
from lakesieve.llm._spark import cut, free_name
from lakesieve.llm.license_texts import FILES, HEADERS, TITLES

THRESHOLD, FILE_THRESHOLD = 0.7, 0.8
#: Lines that a notice may be wrapped over; weight of a template that a block's first line must hold; lines that may hold a title.
BLOCK_LINES, ANCHOR, TITLE_LINES = 8, 0.15, 12
MAX_BROADCAST_DIRS = 200_000
TOKEN = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
MARKS = re.compile(r"^[\s/*#;%!\"'<>-]+|[\s*/>-]+$")


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def plain(name: str | None) -> str | None:
    """A template's licence: what stands before any remark."""
    return name and name.split(" (")[0]


class Models:
    """Unit vectors of the templates under one weighting."""

    def __init__(self, counts: dict[str, int], total: int, headers: dict[str, str], files: dict[str, str], titles: dict[str, str]):
        every = [*headers.values(), *files.values(), *titles.values()]
        self.idf = {t: math.log((total + 1) / (counts.get(t, 0) + 1)) + 1 for body in every for t in tokens(body)}
        self.rare = math.log(total + 1) + 1
        self.headers, self.files, self.titles = ({n: (self.vector(Counter(tokens(b))), len(tokens(b))) for n, b in sorted(x.items())} for x in (headers, files, titles))
        self.of: dict[str, list[tuple[str, float]]] = {}
        for n, (v, _) in self.headers.items():
            for t, x in v.items():
                self.of.setdefault(t, []).append((n, x))

    def vector(self, words: Counter) -> dict[str, float]:
        v = {t: n * self.idf.get(t, self.rare) for t, n in words.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()} if norm else {}

    def cosine(self, words: Counter, model: dict[str, float]) -> float:
        v = self.vector(words)
        return round(sum(x * v.get(t, 0.0) for t, x in model.items()), 6)

    def anchors(self, line: set[str]) -> list[str]:
        """Templates that may begin in a line."""
        weight: dict[str, float] = {}
        for t in line:
            for n, x in self.of.get(t, ()):
                weight[n] = weight.get(n, 0.0) + x * x
        return [n for n, x in weight.items() if x >= ANCHOR]

    def scanned(self, text: str) -> tuple[str | None, float, str | None, float]:
        """(header, its cosine, licence that the file is the text of, its cosine)."""
        lines = [tokens(MARKS.sub("", x)) for x in text.split("\n")]
        best, covered = (0.0, ""), set()
        for i, line in enumerate(lines):
            for name in self.anchors(set(line)):
                model, length = self.headers[name]
                block: Counter = Counter()
                top, reach = 0.0, i
                for j in range(i, min(i + BLOCK_LINES, len(lines))):
                    block.update(lines[j])
                    if block.total() > 2 * length + 4 or not lines[j]:
                        break
                    score = self.cosine(block, model)
                    if score > top:
                        top, reach = score, j
                if top >= THRESHOLD:
                    covered.update(range(i, reach + 1))
                    if top > best[0] or (top == best[0] and name < best[1]):
                        best = top, name
        every = sum(map(len, lines))
        file = (0.0, "")
        if best[1] or any(len(x) > 1 for x in lines[:TITLE_LINES]):
            whole = Counter(t for x in lines for t in x)
            for name, (model, length) in self.files.items():
                if every <= 4 * length and (score := self.cosine(whole, model)) >= FILE_THRESHOLD and score > file[0]:
                    file = score, name
            for name, (model, length) in self.titles.items():
                head: Counter = Counter()
                for x in lines[:TITLE_LINES]:
                    head.update(x)
                    if head.total() > length + 8:
                        break
                    if (score := self.cosine(head, model)) >= FILE_THRESHOLD and score > file[0]:
                        file = score, name
        if not file[1] and best[1] and 2 * sum(len(lines[i]) for i in covered) >= every:
            file = best
        return plain(best[1] or None), best[0], plain(file[1] or None), file[0]


def scan(files: DataFrame, path: str = "path", text: str = "text", headers: dict[str, str] = HEADERS, texts: dict[str, str] = FILES, titles: dict[str, str] = TITLES) -> DataFrame:
    """All columns but the text with header, similarity, licence_file (of which licence the file is the text), licence and
    origin (file, header, inherited or none)."""
    vocabulary = {t for some in (headers, texts, titles) for body in some.values() for t in tokens(body)}
    keep = [c for c in files.columns if c != text]

    def present(batches):
        df: Counter = Counter()
        n = 0
        for batch in batches:
            for x in batch.column(0).to_pylist():
                n += 1
                df.update(vocabulary.intersection(tokens(x or "")))
        yield pa.RecordBatch.from_arrays([pa.array(["", *df]), pa.array([n, *df.values()], pa.int64())], ["t", "n"])

    counts = {r.t: r.n for r in files.select(F.col(f"`{text}`")).mapInArrow(present, "t string, n bigint").groupBy("t").agg(F.sum("n").alias("n")).collect()}  # the templates' words
    models = Models(counts, counts.pop("", 0), headers, texts, titles)
    names = {n: free_name(keep, n) for n in ("header", "similarity", "licence_file", "licence", "origin")}
    folder, given = free_name(keep, "folder"), free_name(keep, "given")

    def measure(some):
        raw, offs = some.data.tobytes(), some.offs.tolist()
        rows = [models.scanned(raw[a:b].decode("utf-8", "replace")) for a, b in zip(offs[:-1], offs[1:], strict=True)]
        return {names["header"]: [r[0] for r in rows], names["similarity"]: [max(r[1], r[3]) for r in rows], names["licence_file"]: [r[2] for r in rows]}

    found = with_measures(files, text, {names["header"]: "string", names["similarity"]: "double", names["licence_file"]: "string"}, measure, keep)
    parts = F.split(F.coalesce(F.col(f"`{path}`"), F.lit("")), "/")
    above = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    found = cut(found.withColumn(folder, F.array_join(above, "/")), "licences")  # read several times below
    file, header = F.col(names["licence_file"]), F.col(names["header"])
    own = found.where(file.isNotNull()).groupBy(F.col(folder).alias("at")).agg(F.min(file).alias("given"))
    folders = found.select(F.col(folder).alias("folder")).distinct().withColumn("parts", F.split("folder", "/"))
    folders = folders.select("folder", F.explode(F.transform(F.sequence(F.lit(0), F.size("parts")), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(F.col("parts"), 1, n), "/").alias("at")))).alias("a"))
    nearest = folders.join(own, F.col("a.at") == F.col("at")).groupBy(F.col("folder").alias(folder)).agg(F.max_by("given", "a.depth").alias(given))
    nearest = cut(nearest, "inherited")
    if nearest.count() <= MAX_BROADCAST_DIRS:
        nearest = F.broadcast(nearest)
    origin = F.when(file.isNotNull(), "file").when(header.isNotNull(), "header").when(F.col(given).isNotNull(), "inherited").otherwise("none")
    licence = F.coalesce(file, header, F.col(given))
    return found.join(nearest, folder, "left").select(*[F.col(f"`{c}`") for c in keep], names["header"], names["similarity"], names["licence_file"], licence.alias(names["licence"]), origin.alias(names["origin"]))
