"""Benchmark decontamination with an Aho-Corasick automaton over normalised test items.

Text and items are lower-cased (A-Z) and cut into words of letters, digits and non-ASCII characters. Every run of
`window` consecutive words of an item is a pattern (an item of fewer words, but not none, is one pattern); the automaton
goes by word numbers, reads each normalised document once, and hits are mapped back to words and to byte offsets of the original text.

Items are the bounded side: an automaton takes BLOCK_WINDOWS patterns, a few hundred MB at most, whatever the benchmark's
size (a longer item is split). A benchmark of more is several blocks; documents pass through them one after another, each in a
stage of its own that reads the state which the one before has written, so a worker holds one automaton at a time.
Null and empty texts have no words and no hits; a document of any length is read at once; an item without words matches
nothing; items of equal id count once, and an item whose id is null makes hits but isn't listed; repeated rows are judged
alike; a name that the kept columns have already gets a leading underscore; empty tables give no rows or no hits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakesieve.llm._bytes import chunks, span_digests, texts_of
from lakesieve.llm._spark import cut, free_name, released

WINDOW = 10
#: Patterns of one automaton; each takes about as many nodes of some 80 bytes as it has words.
BLOCK_WINDOWS = 1 << 17
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
TO_NORMAL = np.frombuffer(NORMAL, np.uint8)

_built: dict[int, tuple] = {}


def words_of(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


class Block:
    """The automaton over a block's windows, with their lengths and the items that have each, and the numbers of its words."""

    def __init__(self, window: int, items: list[tuple[str | None, bytes]]):
        import ahocorasick

        owners: dict[tuple, list] = {}
        numbers: dict[bytes, int] = {}
        for item, text in items:
            words = tuple([numbers.setdefault(w, len(numbers)) for w in text.split()])
            n = min(window, len(words))
            for i in range(len(words) - n + 1 if n else 0):
                of = owners.setdefault(words[i : i + n], [])
                if item is not None and (not of or of[-1] != item):
                    of.append(item)
        self.least = min(map(len, owners), default=0)
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        while owners:
            pattern, of = owners.popitem()
            self.machine.add_word(pattern, (len(pattern), of))
        self.machine.make_automaton()
        self.names = list(numbers)
        every = np.frombuffer(b"".join(self.names), np.uint8)
        ends = np.cumsum([len(w) for w in self.names], dtype=np.int64)
        hashes = span_digests(every, np.concatenate(([0], ends[:-1]))[: len(ends)], ends)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of words by their hashes, -1 for those that no item has."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.order[at], -1)


def _block(sent: Broadcast) -> Block:
    window, items = sent.value
    key = id(items)  # a worker unpickles a broadcast once and keeps it
    if key not in _built:
        _built.clear()
        _built[key] = Block(window, items), items
    return _built[key][0]


def item_blocks(items: DataFrame, item: str, text: str, window: int):
    """Broadcast blocks of (id, words) with BLOCK_WINDOWS windows at most; one at least, maybe empty."""
    spark, rows, size = items.sparkSession, [], 0
    for r in items.select(F.col(f"`{item}`").alias("i"), F.col(f"`{text}`").alias("t")).toLocalIterator():
        words = words_of((r.t or "").encode())
        for at in range(0, max(len(words) - window, 0) + 1, BLOCK_WINDOWS):
            part = words[at : at + BLOCK_WINDOWS + window - 1]
            n = max(len(part) - window, 0) + 1
            if rows and size + n > BLOCK_WINDOWS:
                yield spark.sparkContext.broadcast((window, rows))
                rows, size = [], 0
            rows.append((None if r.i is None else str(r.i), b" ".join(part)))
            size += n
    yield spark.sparkContext.broadcast((window, rows))


def scan(df: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default: all) with n_words, hit_words (word numbers that a window covers), hit_items (sorted
    ids as text) and hit_spans (start and end byte of each maximal run of hit words in the original text)."""
    keep = df.columns if keep is None else keep
    names = {n: free_name(keep, n) for n in ("n_words", "hit_words", "hit_items", "hit_spans")}
    own = [free_name(keep, n) for n in ("_words", "_items", "_text")]
    carried = F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b"")).alias(own[2])
    state = df.select(*[F.col(f"`{c}`") for c in keep], F.array().cast("array<int>").alias(own[0]), F.array().cast("array<string>").alias(own[1]), carried)
    schema = T.StructType([df.schema[c] for c in keep])
    schema = schema.add(names["n_words"], T.LongType()).add(names["hit_words"], T.ArrayType(T.IntegerType())).add(names["hit_items"], T.ArrayType(T.StringType())).add(names["hit_spans"], T.ArrayType(T.ArrayType(T.LongType())))
    blocks = item_blocks(items, item_id, item_text, window)
    last = next(blocks)
    for block in blocks:
        state = cut(state.mapInArrow(_pass(last, None), state.schema), "hits")
        last.unpersist()
        last = block
    return state.mapInArrow(_pass(last, [f.name for f in schema]), schema)


def _pass(sent, names):
    """One block's hits added to the state; with `names`, the state as the result's columns."""

    def run(batches):
        block = _block(sent)
        for whole in batches:
            every, at = texts_of(whole.column(whole.num_columns - 1)), 0
            for at, texts in chunks(every):
                batch = whole.slice(at, len(texts))
                *rest, words, items, raw = batch.columns
                words, items = words.to_pylist(), items.to_pylist()
                normal = TO_NORMAL[texts.data]
                starts, ends, first = texts.words(normal != 32)
                if block.least:
                    _search(block, normal, starts, ends, first, words, items)
                hits = pa.array(words, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))
                if names is None:
                    yield pa.RecordBatch.from_arrays([*rest, *hits, raw], batch.schema.names)
                else:
                    spans = [_spans(starts[a:b] - o, ends[a:b] - o, hit) if hit else [] for a, b, o, hit in zip(first[:-1].tolist(), first[1:].tolist(), texts.offs.tolist(), words, strict=False)]
                    yield pa.RecordBatch.from_arrays([*rest, pa.array(np.diff(first).astype(np.int64)), *hits, pa.array(spans, pa.list_(pa.list_(pa.int64())))], names)

    return released(run)


def _search(block: Block, normal, starts, ends, first, words: list, items: list) -> None:
    """Runs of words that items have, no shorter than the shortest pattern, go through the automaton."""
    numbers = block.numbers(span_digests(normal, starts, ends))
    doc = np.repeat(np.arange(len(words)), np.diff(first))
    known = numbers >= 0
    cut_at = np.concatenate(([True], known[1:] != known[:-1]))[: len(known)] | np.concatenate(([True], doc[1:] != doc[:-1]))[: len(known)]
    begin = np.flatnonzero(cut_at)
    stop = np.concatenate((begin[1:], [len(known)]))[: len(begin)]
    long = known[begin] & (stop - begin >= block.least) if len(begin) else begin
    found: dict[int, tuple[set, set]] = {}
    for a, b in zip(begin[long].tolist(), stop[long].tolist(), strict=True):
        hits = list(block.machine.iter(tuple(numbers[a:b].tolist())))
        if not hits or any(normal[starts[k] : ends[k]].tobytes() != block.names[numbers[k]] for k in range(a, b)):
            if hits:
                raise ValueError("two words share a hash")  # a chance of 2^-64 a pair; never a wrong result
            continue
        i = int(doc[a])
        hit, of = found.setdefault(i, (set(), set()))
        for end, (n, ids) in hits:
            hit.update(range(a + end + 1 - n - int(first[i]), a + end + 1 - int(first[i])))
            of.update(ids)
    for i, (hit, of) in found.items():
        words[i], items[i] = sorted(hit.union(words[i])), sorted(of.union(items[i]))


def _spans(starts, ends, hit: list[int]) -> list[list[int]]:
    """First and last byte of each run of hit words."""
    at = np.array(hit)
    gap = np.flatnonzero(np.diff(at) > 1)
    return [[int(starts[a]), int(ends[b])] for a, b in zip(at[np.concatenate(([0], gap + 1))], at[np.concatenate((gap, [len(at) - 1]))], strict=True)]


def filter_documents(df: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `df` without a hit, with its columns."""
    hits = free_name(df.columns, "hit_words")
    return scan(df, items, text).where(F.size(F.col(hits)) == 0).select(*[F.col(f"`{c}`") for c in df.columns])
