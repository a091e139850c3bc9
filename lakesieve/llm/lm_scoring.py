"""Code length of texts under context-tree weighting over bytes, beside a smoothed unigram base.

A text is its words, A-Z in lower case, with one space between them and an end symbol. Each byte is eight binary
decisions; a decision's context is the byte's bits so far and 0 to DEPTH bytes before it. Every context of the training
documents has a Krichevsky-Trofimov estimate; bottom up over the tree, a node's weighted probability is half its own
block probability and half the product of its children's, and the share of the first is the weight of its estimate
against what deeper contexts say. All depths are mixed so; a path ends at the deepest context that training has seen.

The tree is never in one place: blocks send each distinct (context, byte) with its training count to the task that
has the context's two nearest bytes, where that subtree is whole. A first pass over these messages sums what the subtrees
give to the contexts of one byte and of none, 256 x 255 numbers; in a second one the tasks answer each block with the
probabilities it asked for. Word counts for the base go the same way by word hash. Counts cover all training documents.

Null and empty texts are an end symbol only. A row without id trains as one whose id is the empty text. Rows of equal id
and repeated rows count each; a very long text is a block by itself; only the two columns named are read, so no other
column's name can clash; an empty table gives no rows; without training documents all estimates are the prior's.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesieve.llm._blocks import NO_ID, answered, block_of, blocks_of, pack, rows_of, unpack
from lakesieve.llm._bytes import U64, Texts, cuts, mix, word_hashes
from lakesieve.llm._spark import cut, partitions, released, small_batches

DEPTH = 5
#: The shallowest context that the tasks hold; those of one byte and of none are a table of 65,536 rows at most.
ROOT = 2
END = 0xFF
FOLDS, HELD_OUT = 5, 1
#: Text that one worker handles at once; its keys take some 50 times as much.
BLOCK_BYTES = 2 << 20
BITS = 8 * (DEPTH + 1)
#: Keys that are merged, or whose subtrees are made, at once (more where two bytes alone have more).
RUN_KEYS = 1 << 19
#: Where each pair of nearest bytes goes in the order of the keys, and which pair that is.
ORDER = np.argsort(mix(np.arange(1 << 16).astype(U64) + U64(1))).astype(U64)
PAIR = np.argsort(ORDER)


def trains(ids: np.ndarray) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i == NO_ID else str(i).encode()) % FOLDS != HELD_OUT for i in ids.tolist()], bool)


def stream(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all documents, and where each begins."""
    raw, offs = texts.lowered().data.tobytes(), texts.offs.tolist()
    parts = [b" ".join(raw[a:b].split()) + b"\xff" for a, b in zip(offs[:-1], offs[1:], strict=True)]
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])


def contexts(symbols: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Of each symbol, its DEPTH bytes of context, the nearest in the highest bits, and itself in the lowest."""
    inside = np.arange(len(symbols)) - np.repeat(begin[:-1], np.diff(begin))
    keys = np.zeros(len(symbols), U64)
    for k in range(1, DEPTH + 1):
        before = np.full(len(symbols), END, np.uint8)
        before[k:] = symbols[:-k]
        before[inside < k] = END
        keys |= before.astype(U64) << U64(BITS - 8 * k)
    return keys | symbols.astype(U64)


def place(keys: np.ndarray) -> np.ndarray:
    """Keys with the two nearest bytes dealt anew, so that equal shares of the order are about equal shares of the pairs."""
    low = U64(BITS - 16)
    return ORDER[keys >> low] << low | keys & U64((1 << (BITS - 16)) - 1)


def bucket_starts(buckets: int) -> np.ndarray:
    """The least key of each bucket, and one more."""
    return np.array([-(-(b << 16) // buckets) << (BITS - 16) for b in range(buckets + 1)], U64)


def counted(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys (of 63 bits) and how often each stands in training."""
    both = np.sort(keys << U64(1) | train.astype(U64))
    if not len(both):
        return both, np.zeros(0, np.int64)
    own = both >> U64(1)
    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    return own[first], np.add.reduceat((both & U64(1)).astype(np.int64), first)


TABLE = 1 << 14
_HALF = np.array([math.lgamma(n + 0.5) for n in range(TABLE)])
_WHOLE = np.array([math.lgamma(n + 1) for n in range(TABLE)])


def _lgamma(n: np.ndarray, table: np.ndarray, plus: float) -> np.ndarray:
    """The logarithm of gamma(n + plus) for whole n."""
    out = table[np.minimum(n, TABLE - 1).astype(np.int64)]
    big = np.flatnonzero(n >= TABLE)
    y = n[big] + plus
    out[big] = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3)
    return out


def block_log(ones: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The logarithm of the Krichevsky-Trofimov probability of a block with so many ones."""
    return _lgamma(ones, _HALF, 0.5) + _lgamma(total - ones, _HALF, 0.5) - _lgamma(total, _WHOLE, 1.0) - math.log(math.pi)


def weigh(ones: np.ndarray, total: np.ndarray, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(weighted log probability, share of a node's own estimate), given the sum of its children's."""
    block = block_log(ones, total)
    if below is None:
        return block, np.ones(len(block))
    weighted = np.logaddexp(block, below) - math.log(2)
    return weighted, np.exp(block - math.log(2) - weighted)


def levels(keys: np.ndarray, counts: np.ndarray, b: int) -> list[tuple[np.ndarray, ...]]:
    """Of bit b, the nodes of DEPTH bytes of context down to ROOT: (node, ones, total, share, weighted, place of each node or, at
    DEPTH, key of the level before). Keys are sorted and distinct; a node that training has not seen has a total of 0."""
    symbol = keys & U64(255)
    nodes = keys >> U64(8) << U64(8) | U64(1 << b) | symbol >> U64(8 - b)
    bit = (symbol >> U64(7 - b)) & U64(1)
    first = np.flatnonzero(np.concatenate(([True], nodes[1:] != nodes[:-1])))
    inside = np.cumsum(np.concatenate(([False], nodes[1:] != nodes[:-1])))
    weight = counts.astype(float)
    nodes, total, ones = nodes[first], np.add.reduceat(weight, first), np.add.reduceat(weight * bit, first)
    weighted, share = weigh(ones, total, None)
    out = [(nodes, ones, total, share, weighted, inside)]
    for _ in range(DEPTH - ROOT):
        nodes, inside = np.unique(nodes >> U64(16) << U64(8) | nodes & U64(255), return_inverse=True)
        total, ones, below = (np.bincount(inside, x, len(nodes)) for x in (total, ones, weighted))
        weighted, share = weigh(ones, total, below)
        out.append((nodes, ones, total, share, weighted, inside))
    return out


class Top:
    """Contexts of one byte and of none: estimates, shares and whether training has seen them, by (nearest byte, node)."""

    def __init__(self, sums: np.ndarray):
        total, ones, below = (x.reshape(256, 256) for x in sums)
        weighted, share = (x.reshape(256, 256) for x in weigh(ones.ravel(), total.ravel(), below.ravel()))
        weighted = np.where(total > 0, weighted, 0.0)
        self.total, self.share, self.estimate = total, share, (ones + 0.5) / (total + 1)
        self.least = total.sum(0)
        _, self.least_share = weigh(ones.sum(0), self.least, weighted.sum(0))
        self.least_estimate = (ones.sum(0) + 0.5) / (self.least + 1)

    def mixed(self, nearest: np.ndarray, node: np.ndarray, deeper: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """The chance of a one, from that under the contexts of ROOT bytes where these are seen."""
        own, share = self.estimate[nearest, node], self.share[nearest, node]
        one = np.where(seen, share * own + (1 - share) * deeper, own)
        own, share = self.least_estimate[node], self.least_share[node]
        return np.where(self.total[nearest, node] > 0, share * own + (1 - share) * one, np.where(self.least[node] > 0, own, 0.5))


def pieces(keys: np.ndarray):
    """Ranges of about RUN_KEYS sorted keys that hold whole pairs of nearest bytes."""
    edge = np.concatenate((np.flatnonzero(np.diff(keys >> U64(BITS - 16))) + 1, [len(keys)]))
    at = 0
    while at < len(keys):
        after = edge[np.searchsorted(edge, at, "right") :]
        stop = int(after[max(int(np.searchsorted(after, at + RUN_KEYS, "right")) - 1, 0)])
        yield at, stop
        at = stop


def nearest_of(keys: np.ndarray) -> np.ndarray:
    return PAIR[keys >> U64(BITS - 16)] >> 8


def top_sums(keys: np.ndarray, counts: np.ndarray, out: np.ndarray) -> None:
    """Adds to `out` (3, 65536) what these subtrees give to the contexts of one byte: totals, ones and log probabilities."""
    for at, stop in pieces(keys):
        for b in range(8):
            nodes, ones, total, _, weighted, _ = levels(keys[at:stop], counts[at:stop], b)[-1]
            k = (nearest_of(nodes >> U64(8) << U64(BITS - 16)) << 8) | (nodes & U64(255)).astype(np.int64)
            for row, values in enumerate((total, ones, weighted)):
                out[row] += np.bincount(k, values, 1 << 16)


def log_probability(keys: np.ndarray, counts: np.ndarray, top: Top) -> np.ndarray:
    """Natural logarithm of each key's byte in its context."""
    out = np.zeros(len(keys))
    for at, stop in pieces(keys):
        some = keys[at:stop]
        symbol, nearest = (some & U64(255)).astype(np.int64), nearest_of(some)
        for b in range(8):
            at_node = chance = alive = None  # of each key: its node, the chance of a one from there on, whether training has seen it
            for _, ones, total, share, _, inside in levels(some, counts[at:stop], b):
                at_node = inside if at_node is None else inside[at_node]
                own, part = ((ones + 0.5) / (total + 1))[at_node], share[at_node]
                chance = own if alive is None else np.where(alive, part * own + (1 - part) * chance, own)
                alive = (total > 0)[at_node]
            node = (1 << b) | symbol >> (8 - b)
            one = top.mixed(nearest, node, chance, alive)
            out[at:stop] += np.log(np.where((symbol >> (7 - b)) & 1 == 1, one, 1 - one))
    return out


def _words(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    low = texts.lowered()
    starts, ends, first = low.words()
    return word_hashes(low, starts, ends) >> U64(1), first


def _asked(buckets: int):
    starts = bucket_starts(buckets)

    def run(batches):
        for row in rows_of(batches, "block", "ids", "offs", "raw"):
            number, ids, texts = block_of(row)
            train = trains(ids)
            symbols, begin = stream(texts)
            grams = counted(place(contexts(symbols, begin)), np.repeat(train, np.diff(begin)))
            hashes, first = _words(texts)
            words = counted(hashes, np.repeat(train, np.diff(first)))
            out = []
            edge = np.searchsorted(grams[0], starts).tolist()
            near = cuts(words[0] << U64(1), buckets).tolist()
            for b in range(buckets):
                if edge[b + 1] > edge[b]:
                    out.append((b, 0, pack(grams[0][edge[b] : edge[b + 1]], grams[1][edge[b] : edge[b + 1]].astype(np.uint32))))
                if near[b + 1] > near[b]:
                    out.append((b, 1, pack(words[0][near[b] : near[b + 1]], words[1][near[b] : near[b + 1]].astype(np.uint32))))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([number] * len(out), pa.int64()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())], ["bucket", "block", "kind", "blob"])

    return run


def merged(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of sorted runs, and the sums of their counts; never much more than twice what is distinct at once."""
    keys, counts = np.zeros(0, U64), np.zeros(0, np.int64)
    held, size = [], 0
    for i, blob in enumerate(blobs):
        run = unpack(blob)
        held.append(run)
        size += len(run[0])
        if size >= max(RUN_KEYS, len(keys)) or i == len(blobs) - 1:
            every, n = np.concatenate([keys, *(x[0] for x in held)]), np.concatenate([counts, *(x[1].astype(np.int64) for x in held)])
            order = np.argsort(every, kind="stable")
            every = every[order]
            first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
            keys, counts = every[first], np.add.reduceat(n[order], first)
            held, size = [], 0
    return keys, counts


def _by_bucket(batches):
    """((bucket, kind), [(block, blob)]) of all that a task has, packed as it came."""
    held: dict[tuple[int, int], list[tuple[int, bytes]]] = {}
    for row in rows_of(batches):
        held.setdefault((row["bucket"], row["kind"]), []).append((row["block"], row["blob"]))
    while held:
        yield held.popitem()


def _tops(batches):
    """By (nearest byte, node), what the subtrees give to it; -1 has the words and tokens of the task."""
    out, words, tokens = np.zeros((3, 1 << 16)), 0, 0
    for (_, kind), of in _by_bucket(batches):
        keys, counts = merged([x for _, x in of])
        if kind == 0:
            top_sums(keys, counts, out)
        else:
            words, tokens = words + int((counts > 0).sum()), tokens + int(counts.sum())
    k = np.flatnonzero(out[0])
    yield pa.RecordBatch.from_arrays([pa.array(np.append(k, -1).astype(np.int32)), *(pa.array(np.append(x[k], y)) for x, y in zip(out, (words, tokens, 0), strict=True))], ["k", "total", "ones", "below"])


def _told(top):
    """For each block, the logarithms and counts it asked for."""

    def run(batches):
        weights = None
        for (b, kind), of in _by_bucket(batches):
            keys, values = merged([x for _, x in of])
            if kind == 0:
                weights = weights or Top(top.value)
                values = log_probability(keys, values, weights).astype(np.float32)
            for block, blob in of:
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([pack(np.array([kind, b]), values[np.searchsorted(keys, unpack(blob)[0])])], pa.binary())], ["block", "blob"])

    return run


def _scored(batches):
    for row in rows_of(batches):
        _, ids, texts = block_of(row)
        told: tuple[dict, dict] = {}, {}
        for blob in row["answers"] or ():
            (kind, b), values = unpack(blob)
            told[int(kind)][int(b)] = values
        symbols, begin = stream(texts)
        logs = _looked_up(place(contexts(symbols, begin)), told[0]).astype(float)
        total = np.concatenate(([0], np.cumsum(logs)))
        hashes, first = _words(texts)
        counts = _looked_up(hashes, told[1]).astype(float)
        base, known = np.concatenate(([0], np.cumsum(np.log10(counts + 0.5)))), np.concatenate(([0], np.cumsum(counts > 0)))
        columns = [
            pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(~trains(ids)), pa.array(np.diff(first).astype(np.int64)), pa.array((known[first[1:]] - known[first[:-1]]).astype(np.int64)),
            pa.array(base[first[1:]] - base[first[:-1]]), pa.array((total[begin[1:]] - total[begin[:-1]]) / np.log(10)), pa.array(np.diff(begin).astype(np.int64)),
        ]
        yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCORED.split(", ")])


SCORED = "doc_id bigint, held_out boolean, n_words bigint, n_known bigint, base double, score double, n_symbols bigint"


def _looked_up(keys: np.ndarray, told: dict[int, np.ndarray]) -> np.ndarray:
    """The answer to each key: answers stand by bucket in the order of the distinct keys."""
    distinct, inverse = np.unique(keys, return_inverse=True)
    values = np.concatenate([np.zeros(0, np.float32), *(told[b] for b in sorted(told))])
    if len(values) != len(distinct):
        raise ValueError(f"{len(values)} answers to {len(distinct)} questions")
    return values[inverse] if len(values) else np.zeros(0)


def score(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_symbol."""
    n = partitions(df)
    buckets = min(2 * n, 1 << 16)  # a pair of bytes is never split
    spark = df.sparkSession
    blocks = blocks_of(df, doc_id, text, [], BLOCK_BYTES)
    with small_batches(spark):
        asked = blocks.mapInArrow(released(_asked(buckets)), "bucket int, block bigint, kind int, blob binary").repartition(n, "bucket").persist(StorageLevel.DISK_ONLY)
        sums, totals = np.zeros((3, 1 << 16)), (0, 0)
        for k, *x in asked.mapInArrow(released(_tops), "k int, total double, ones double, below double").groupBy("k").agg(F.sum("total"), F.sum("ones"), F.sum("below")).collect():  # 65,537 rows at most
            if k < 0:
                totals = int(x[0]), int(x[1])
            else:
                sums[:, k] = x
        top = spark.sparkContext.broadcast(sums)
        told = asked.mapInArrow(released(_told(top)), "block bigint, blob binary")
        found = cut(answered(blocks, told).mapInArrow(released(_scored), SCORED), "lm-scores")
        asked.unpersist(True)
    own = F.crc32(F.coalesce(df[doc_id].cast("string"), F.lit("")).cast("binary")) % FOLDS
    ends = df.where(own != HELD_OUT).count()
    words, tokens = totals[0] + (ends > 0), totals[1] + ends
    n_tokens = F.col("n_words") + 1
    base = F.col("base") + float(np.log10(ends + 0.5)) - n_tokens * float(np.log10(tokens + 0.5 * (words + 1)))
    return found.select(
        "doc_id", "held_out", n_tokens.alias("n_tokens"), (F.col("n_known") + int(ends > 0)).alias("n_known"), F.lit(tokens).cast("bigint").alias("train_tokens"), base.alias("base_score"), "score",
        (-F.col("score") / F.col("n_symbols") * float(np.log2(10))).alias("bits_per_symbol"),
    )
