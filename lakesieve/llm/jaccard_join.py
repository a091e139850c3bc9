"""Set similarity self-join on word shingles: universe partitions, the pigeonhole principle and exact verification.

Sets of similar size share a band. Two sets of at most R elements with Jaccard similarity t or more differ in at most
H = floor(2R(1-t)/(1+t)) elements. A band's universe is hashed into segments; a segment with v = 0 is indexed by the subset of
the set's elements that falls into it, one with v = 1 by that subset and all its one-deletion neighbours, which also
finds partners that differ there by one element. If the sum of v + 1 exceeds H, some segment must match. How many
segments get v = 1 is chosen for each band by cost (index entries against expected chance matches; with the constants
below only the smallest bands get any). An empty subset is never indexed: a set for which that leaves too little is
indexed under further hash seeds, and under every element if all fail.

Sets that share an entry form a group. A member leaves its groups of over HOT members if its entries in smaller ones, of
two elements or more and under the first seed, meet every similar set by themselves, so that a common passage is no
reason to compare all who have it. Members of all groups with the same least id are the cluster of that id, its center.

Verification. Every member is compared with its center; that gives most links, and the members' differences from the
center. With k = (w + t) * |difference| - (w - t) * |set| for similarity t / w, two members are similar if and only if their
differences share at least (k + k') / (2 (w + t)) elements. Members that those links leave in different components
meet by the rarest elements of their differences only (a prefix filter), first with the least k of each element, then, in
what is still apart, with one another. So a large family whose members are each some way from the others costs neither
all pairs nor a comparison with whole sets. A cluster with up to CLUSTER_TOKENS elements of differences is one task's,
larger ones are spread by element. Differences are taken on the upper halves of the 64-bit hashes, which only makes sets
look more alike; what that could decide is compared again by whole hashes. Centers are salted by their number of members.

Texts without words and null texts have an empty set and no links. A row without id is linked with nothing and has no
component. Rows of equal id count as one document: they share a component and each keeps its own set size. Repeated rows
and ties are links of similarity 1. Texts of any length are one set; a very long one is a chunk by itself. An empty table
gives no rows. Only the columns named are read, so no other column's name can clash; `one_of_each` returns them all.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakesieve.llm._blocks import NO_ID, pack, unpack
from lakesieve.llm._bytes import U64, Texts, bucket_of, chunks, cuts, mix, run_hashes, texts_of, windows, word_hashes
from lakesieve.llm._spark import cut, partitions, released, scratch, small_batches
from lakesieve.llm.components import components

WORDS = 5
#: Similarity as a fraction of whole numbers.
SIMILARITY = (80, 100)
#: Groups of more members are left by those who can do without.
HOT = 16
SEEDS = 6
GROWTH = (3, 2)
#: Segments beyond those the pigeonhole asks for, as a share of H: a set can then leave out its subsets of one element.
SPARE = 0.2
#: Cost of a chance match against that of an index entry, and the share of elements that two sets have by chance.
MATCH_COST, CHANCE = 50.0, 0.15
#: Members that one task compares with the same center.
SALT_LINKS = 500
#: Elements of differences that one task handles as one cluster.
CLUSTER_TOKENS = 1 << 20
#: Pairs of postings that are looked at together.
STEP_PAIRS = 1 << 20
MAX_BROADCAST_IDS = 4_000_000


def shingle_sets(texts: Texts, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, side by side, and the size of each set."""
    texts = texts.lowered()
    starts, ends, first = texts.words()
    hashes = word_hashes(texts, starts, ends)
    every, at = windows(hashes, first, words)
    begin = np.searchsorted(at, first).tolist()
    count, firsts = np.diff(first), first.tolist()
    few = np.flatnonzero((count > 0) & (count < words))
    whole = dict(zip(few.tolist(), mix(run_hashes(hashes, first[few], count[few]) + count[few].astype(U64)), strict=True))
    parts = []
    for i in range(len(texts)):
        if i in whole:
            parts.append(np.array([whole[i]], U64))
        elif firsts[i + 1] > firsts[i]:
            own = np.sort(every[begin[i] : begin[i + 1]])
            parts.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        else:
            parts.append(np.zeros(0, U64))
    return np.concatenate([np.zeros(0, U64), *parts]), np.array([len(p) for p in parts], np.int64)


@lru_cache
def bands(largest: int) -> np.ndarray:
    """Least size of each band, up to one beyond `largest`."""
    out = [1]
    while out[-1] <= largest:
        out.append(max(out[-1] + 1, out[-1] * GROWTH[0] // GROWTH[1]))
    return np.array(out, np.int64)


@lru_cache
def plan(most: int, similarity: tuple[int, int] = SIMILARITY) -> tuple[int, int, int]:
    """(H, segments with v = 1, segments with v = 0) for sets of up to `most` elements, at the least cost."""
    t, whole = similarity
    differ = 2 * most * (whole - t) // (whole + t)
    need = differ + 1 + math.ceil(SPARE * differ)  # some to spare for subsets of no element or one
    best = None
    for pairs in range(need // 2 + 1):
        single = need - 2 * pairs
        segments = pairs + single
        load = most / segments
        cost = single + pairs * (1 + load) + MATCH_COST * segments * CHANCE**load
        if best is None or cost < best[0]:
            best = (cost, pairs, single)
    return differ, best[1], best[2]


def entries(tokens: np.ndarray, sizes: np.ndarray, band: np.ndarray, seed: int, edges: np.ndarray, similarity) -> tuple[np.ndarray, ...]:
    """(entry, set number) of the index, what each set has to spare (below 0: it isn't covered) and how many of its
    entries of two elements it can lose and still meet all similar sets by the others. Odd entries are those that count."""
    plans = np.array([plan(int(edges[b + 1]) - 1, similarity) for b in band.tolist()], np.int64).reshape(-1, 3)
    differ, pairs, segments = plans[:, 0], plans[:, 1], plans[:, 1] + plans[:, 2]
    of = np.repeat(np.arange(len(sizes)), sizes)
    base = np.concatenate(([0], np.cumsum(segments)))
    rolled = mix(tokens ^ mix((band[of].astype(U64) << U64(8)) + U64(seed + 1)))
    local = (((rolled >> U64(32)) * segments[of].astype(U64)) >> U64(32)).astype(np.int64)
    place = base[of] + local
    value = mix(rolled)
    sums, counts = np.zeros(base[-1], U64), np.bincount(place, minlength=base[-1])
    np.add.at(sums, place, value)
    owner = np.repeat(np.arange(len(sizes)), segments)
    number = np.arange(base[-1]) - base[owner]
    tag = mix((band[owner].astype(U64) << U64(40)) + (number.astype(U64) << U64(8)) + U64(seed))
    double = number < pairs[owner]
    lost = np.where(double, np.where(counts <= 1, 2, 0), counts == 0)
    t, whole = similarity
    differ = np.minimum(differ, sizes * (whole - t) // t)  # a set's own size bounds how far a partner can differ
    spare = 2 * pairs + plans[:, 2] - np.bincount(owner, lost, len(sizes)).astype(np.int64) - differ - 1
    # subsets of one element match by chance; a set that can do without leaves them out, and those that can't still meet
    single = np.bincount(owner, (counts == 1) & ~double, len(sizes)).astype(np.int64)
    bare = spare >= single
    spare = np.where(bare, spare - single, spare)
    counting = (counts > 1) & (pairs[owner] == 0) & (seed == 0)
    free = np.maximum(np.bincount(owner, counting, len(sizes)).astype(np.int64) - differ, 0)
    full = np.flatnonzero((counts > 1) | ((counts == 1) & ~bare[owner]))
    near = np.flatnonzero(double[place] & (counts[place] > 1))
    even = ~U64(1)
    out = np.concatenate((mix(sums[full] + tag[full]) & even | counting[full].astype(U64), mix(sums[place[near]] - value[near] + tag[place[near]]) & even))
    return out, np.concatenate((owner[full], of[near])), spare, free


def index(tokens: np.ndarray, sizes: np.ndarray, similarity=SIMILARITY) -> tuple[np.ndarray, ...]:
    """(entry, row, set, band, free): all index entries of the sets; rows number the (set, band) pairs, of which the last three tell."""
    edges = bands(int(sizes.max(initial=1)) * 2 + 2)
    own = np.searchsorted(edges, sizes, "right") - 1
    some = np.flatnonzero(sizes > 0)
    above = some[similarity[1] * sizes[some] >= similarity[0] * edges[own[some] + 1]]
    sets = np.concatenate((some, above))
    band = np.concatenate((own[some], own[above] + 1))
    starts = np.cumsum(sizes) - sizes
    spare, free = np.full(len(sets), -1), np.zeros(len(sets), np.int64)
    found, rows = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for seed in range(SEEDS):
        left = np.flatnonzero(spare < 0)
        if not len(left):
            break
        size = sizes[sets[left]]
        at = np.repeat(starts[sets[left]] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        entry, owner, spare[left], spared = entries(tokens[at], size, band[left], seed, edges, similarity)
        free[left] = np.maximum(free[left], spared)
        found.append(entry)
        rows.append(left[owner])
    left = np.flatnonzero(spare < 0)
    if len(left):  # by every element
        size = sizes[sets[left]]
        at = np.repeat(starts[sets[left]] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        of = np.repeat(left, size)
        found.append(mix(tokens[at] ^ mix(band[of].astype(U64) + U64(0x51ED27))) & ~U64(1))
        rows.append(of)
    return np.concatenate(found), np.concatenate(rows), sets, band, np.minimum(free, 0xFFFF)


ROW = "bucket int, kind string, blob binary"
NAMES = ["bucket", "kind", "blob"]


def _batch(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.binary())], NAMES)


def _messages(buckets: int, words: int, similarity):
    """Of each chunk of documents: set sizes, links between equal sets, and index entries by bucket."""

    def run(batches):
        for batch in batches:
            known = np.asarray(batch.column(0).is_valid())
            every = np.where(known, np.asarray(batch.column(0).fill_null(0)), NO_ID)
            for at, texts in chunks(texts_of(batch.column(1))):
                ids, have = every[at : at + len(texts)], known[at : at + len(texts)]
                tokens, sizes = shingle_sets(texts, words)
                rows = [(int(ids[0] % buckets), "sizes", pack(ids, sizes))]
                starts = np.concatenate(([0], np.cumsum(sizes))).tolist()
                first: dict[bytes, int] = {}
                alone, twins = np.zeros(len(ids), bool), []
                for i in np.argsort(ids, kind="stable").tolist():
                    if sizes[i] and have[i]:
                        lead = first.setdefault(tokens[starts[i] : starts[i + 1]].tobytes(), i)
                        if lead == i:
                            alone[i] = True
                        elif ids[lead] != ids[i]:
                            twins.append((ids[lead], ids[i]))
                if twins:
                    rows.append((rows[0][0], "links", pack(*np.array(twins, np.int64).T)))
                entry, row, sets, band, free = index(tokens[np.repeat(alone, sizes)], sizes[alone], similarity)
                ids, size = ids[alone], sizes[alone]
                order = np.argsort(entry)
                entry, row = entry[order], row[order]
                edge = cuts(entry, buckets).tolist()
                for b in range(buckets):
                    if edge[b + 1] > edge[b]:
                        used, mine = np.unique(row[edge[b] : edge[b + 1]], return_inverse=True)
                        rows.append((b, "entries", pack(entry[edge[b] : edge[b + 1]], mine.astype(np.uint16 if len(used) < 1 << 16 else np.uint32), ids[sets[used]], band[used].astype(np.uint8), free[used].astype(np.uint16), size[sets[used]].astype(np.uint32))))
                yield _batch(rows)

    return run


CLOSE, MANY = 1, 2
#: Stands for the band of pairs that no member leaves.
NO_BAND = 255


def _distinct(a: np.ndarray, b: np.ndarray, band: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each (a, b, band) once, with all its flags."""
    by = np.lexsort((band, b, a))
    a, b, band, flags = a[by], b[by], band[by], flags[by]
    at = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (band[1:] != band[:-1]))))[: len(a)]
    return a[at], b[at], band[at].astype(np.uint8), np.bitwise_or.reduceat(flags, at).astype(np.uint8)


def _stars(found: DataFrame, n: int) -> DataFrame:
    """(a, b, band, f): the pairs of all groups, each once."""

    def run(batches):
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for part, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(part, []).append(blob)
        while held:
            _, blobs = held.popitem()
            columns = _distinct(*(np.concatenate(c) for c in zip(*map(unpack, blobs), strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["a", "b", "band", "f"])

    return found.where("kind = 'stars'").select("bucket", "blob").repartition(n, "bucket").mapInArrow(released(run), "a bigint, b bigint, band bigint, f bigint")


def _groups(hot: int, similarity, shares: int = 1):
    """Of groups of two or more ids that share an entry: (least id, member) with the flags CLOSE, if their sizes are alike, and
    MANY, if the group has others; those of large groups by band, and how many such entries that count a member has.

    Pairs go out by the least id's hash, in `shares`, as most are found under several entries.
    """

    def run(batches):
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for b, kind, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == "entries":
                    held.setdefault(b, []).append(blob)
                else:
                    yield _batch([(b, kind, blob)])
        while held:
            b, blobs = held.popitem()
            parts = [unpack(x) for x in blobs]
            entry, row = np.concatenate([p[0] for p in parts]), np.concatenate([p[1].astype(np.int64) + n for p, n in zip(parts, np.cumsum([0, *(len(p[2]) for p in parts)]), strict=False)])
            ids, band, free, sizes = (np.concatenate([p[k] for p in parts]).astype(np.int64) for k in (2, 3, 4, 5))
            del parts
            order = np.argsort(entry)
            ordered = entry[order]
            near = np.concatenate(([False], ordered[1:] == ordered[:-1], [False]))
            many = order[(near[1:] | near[:-1])[: len(order)]]
            many = many[np.lexsort((ids[row[many]], entry[many]))]
            key, member = entry[many], ids[row[many]]
            keep = np.concatenate(([True], (key[1:] != key[:-1]) | (member[1:] != member[:-1])))[: len(key)]
            key, member, row = key[keep], member[keep], row[many[keep]]
            if not len(key):
                continue
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.concatenate((first, [len(key)])))
            rows = []
            large = np.repeat(size > hot, size)
            if large.any():
                used, at = np.unique(row[large], return_inverse=True)
                n = np.bincount(at, (key[large] & U64(1)).astype(float)).astype(np.int64)
                rows.append((b, "load", pack(ids[used], band[used], n, free[used])))
            lead = np.repeat(first, size)
            n, m = sizes[row[lead]], sizes[row]
            close = similarity[1] * np.minimum(n, m) >= similarity[0] * np.maximum(n, m)
            flags = np.where(close, CLOSE, 0) | np.where(np.repeat(size > 2, size), MANY, 0)
            other = (member[lead] != member) & (flags > 0)
            for kind, some in (("stars", other & ~large), ("large stars", other & large)):
                if some.any():
                    pairs = _distinct(member[lead[some]], member[some], band[row[some]] if kind != "stars" else np.full(int(some.sum()), NO_BAND), flags[some])
                    part = bucket_of(mix(pairs[0].astype(U64)), shares).astype(np.int64)
                    by = np.argsort(part, kind="stable")
                    edge = np.searchsorted(part[by], np.arange(shares + 1)).tolist()
                    rows += [(p, "stars", pack(*(c[by[edge[p] : edge[p + 1]]] for c in pairs))) for p in range(shares) if edge[p + 1] > edge[p]]
            yield _batch(rows)

    return run


def _rows(table: DataFrame, kind: str, schema: str) -> DataFrame:
    """The rows of the blobs of a kind."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                columns = [c.view(np.int64) if c.dtype == U64 else c.astype(np.int64) for c in unpack(blob)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return table.where(F.col("kind") == kind).select("blob").mapInArrow(run, schema)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements of b are in a, both sorted."""
    return int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum()) if len(a) and len(b) else 0


def doubt(n, m):
    """Elements by which sets of n and m halved hashes may look more alike, but for a chance of 2^-64."""
    bits = 32 - np.log2(np.maximum(n, 1)) - np.log2(np.maximum(m, 1))
    return np.where(bits > 1, np.ceil(64 / np.maximum(bits, 1)), np.inf)


def _set_table(docs: DataFrame, ids: DataFrame, doc_id: str, text: str, words: int, halved: bool) -> DataFrame:
    """(id, n, blob) of the documents in `ids`: the set's size and its sorted hashes, whole or their upper halves."""
    few = ids.count() <= MAX_BROADCAST_IDS
    chosen = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("t"))
    chosen = chosen.join(F.broadcast(ids) if few else ids, "id", "left_semi")

    def run(batches):
        for batch in batches:
            for at, texts in chunks(texts_of(batch.column(1))):
                tokens, sizes = shingle_sets(texts, words)
                ends = np.cumsum(sizes).tolist()
                sets = (tokens[e - n : e] for e, n in zip(ends, sizes.tolist(), strict=True))
                raw = [(np.unique((x >> U64(32)).astype(np.uint32)) if halved else x).tobytes() for x in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(sizes), pa.array(raw, pa.binary())], ["id", "n", "blob"])

    return cut(chosen.mapInArrow(released(run), "id bigint, n bigint, blob binary"), "sets")


COMPARED = "a bigint, v bigint, b bigint, n bigint, similar boolean, sure boolean, many boolean, k bigint, d bigint, blob binary"


def _compared(pairs: DataFrame, sets: DataFrame, halved: bool, similarity) -> DataFrame:
    """COMPARED of the `pairs` (a, b, f): whether they are similar by these hashes and whether that is sure; with MANY in f, also b's difference from a.

    Where an id has several sets, v is the number of a's, and any of them will do for a link.
    """
    t, whole = similarity
    kind = np.uint32 if halved else U64
    hubs = cut(pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT_LINKS).cast("int").alias("salts")).where("salts > 1"), "hubs")
    if hubs.count() <= MAX_BROADCAST_IDS:
        hubs = F.broadcast(hubs)
    salts = F.coalesce("salts", F.lit(1))
    lead = pairs.select("a").distinct().join(hubs, "a", "left").select(F.col("a").alias("id"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt")).join(sets, "id")
    lead = lead.select(F.col("id").alias("a"), "salt", F.lit(None).cast("bigint").alias("b"), F.lit(0).alias("f"), "n", "blob")
    other = pairs.join(hubs, "a", "left").select("a", F.pmod(F.xxhash64("b"), salts).cast("int").alias("salt"), F.col("b").alias("id"), F.col("f").cast("int").alias("f")).join(sets, "id")
    other = other.select("a", "salt", F.col("id").alias("b"), "f", "n", "blob")

    def run(batches):
        at, own = None, []
        for batch in batches:
            out = []
            for a, salt, b, f, n, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mine = np.frombuffer(blob, kind)
                if at != (a, salt):
                    at, own = (a, salt), []
                if b is None:
                    own.append((n, mine))
                    continue
                for v, (m, x) in enumerate(own):
                    d = len(x) + len(mine) - 2 * _common(x, mine)
                    left = (whole - t) * (n + m) - (whole + t) * d
                    similar = left >= 0 and n > 0 and m > 0
                    sure = bool(similar and (not halved or left >= 2 * (whole + t) * doubt(n, m)))
                    many = bool(f & MANY)
                    apart = np.setxor1d(x, mine, assume_unique=True) if many else None
                    out.append((a, v, b, n, similar, sure, many, (whole + t) * d - (whole - t) * n, d, None if apart is None else apart.tobytes()))
            columns = list(zip(*out, strict=True)) or [()] * len(NAMED)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, KINDS, strict=True)], NAMED)

    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return lead.unionByName(other).repartition(n, "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first(), "n", "blob").mapInArrow(released(run), COMPARED)


NAMED = [x.split()[0] for x in COMPARED.split(", ")]
KINDS = [{"bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[x.split()[1]] for x in COMPARED.split(", ")]


def verified(pairs: DataFrame, docs: DataFrame, doc_id: str, text: str, words: int = WORDS, similarity=SIMILARITY) -> DataFrame:
    """Those of the `pairs` (a, b) of documents whose whole sets are similar enough."""
    pairs = cut(pairs.select("a", "b", F.lit(0).alias("f")).distinct(), "pairs")
    sets = _set_table(docs, _ends(pairs), doc_id, text, words, False)
    return cut(_compared(pairs, sets, False, similarity).where("similar").select("a", "b").distinct(), "links")


def _ends(pairs: DataFrame) -> DataFrame:
    return cut(pairs.select(F.col("a").alias("id")).distinct().unionByName(pairs.select(F.col("b").alias("id")).distinct()).distinct(), "ids")


def postings(own: np.ndarray, token: np.ndarray, k: np.ndarray, d: np.ndarray, component: np.ndarray, unit: int) -> tuple[np.ndarray, ...]:
    """(member, token, reach) by token and k, of members' elements by which they can meet one of another component.

    Elements are ordered by rarity, those that only one component has first. If the first one that two similar members share
    has `ahead` others before it in a member, they share at most d - ahead, so the partner's k is within reach = unit * (d - ahead) - k.
    """
    by = np.lexsort((component[own], token))
    first = np.flatnonzero(np.concatenate(([True], token[by][1:] != token[by][:-1])))[: len(by)]
    size = np.diff(np.concatenate((first, [len(by)])))
    held = component[own[by]]
    some = by[np.repeat(held[first] != held[first + size - 1], size)] if len(by) else by
    n = np.bincount(token, minlength=1)
    some = some[np.lexsort((token[some], n[token[some]], own[some]))]
    mine = np.bincount(own[some], minlength=len(d))
    ahead = (d - mine)[own[some]] + np.arange(len(some)) - (np.cumsum(mine) - mine)[own[some]]
    own, token, reach = own[some], token[some], unit * (d[own[some]] - ahead) - k[own[some]]
    by = np.lexsort((own, k[own], token))
    own, token, reach = own[by], token[by], reach[by]
    while True:  # whoever goes may have been the only one within another's reach
        first = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))[: len(token)]
        least = np.repeat(k[own[first]], np.diff(np.concatenate((first, [len(token)]))))
        able = reach >= least
        if able.all():
            return own, token, reach
        own, token, reach = own[able], token[able], reach[able]


def meetings(own: np.ndarray, token: np.ndarray, reach: np.ndarray, k: np.ndarray, component: np.ndarray, one: bool):
    """Pairs of members that meet within both's reach, in pieces; with `one`, only with the least k of each element."""
    first = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))[: len(token)]
    size = np.diff(np.concatenate((first, [len(token)])))
    number, start = np.repeat(np.arange(len(first)), size), np.repeat(first, size)
    low = int(k.min(initial=0))
    span = int(k.max(initial=0)) - low + 2
    place = number * span + (k[own] - low)
    within = np.searchsorted(place, number * span + np.clip(reach - low, -1, span - 1), "right") - start
    count = np.minimum(np.clip(within, 0, None), np.arange(len(own)) - start)  # those before it in the list
    if one:
        count = np.minimum(count, 1)
    total, at = np.concatenate(([0], np.cumsum(count))), 0
    while at < len(own):
        stop = max(int(np.searchsorted(total, total[at] + STEP_PAIRS, "right")) - 1, at + 1)
        some = np.repeat(np.arange(at, stop), count[at:stop])
        other = start[some] + np.arange(len(some)) - (total[some] - total[at])
        fits = (component[own[some]] != component[own[other]]) & (k[own[some]] <= reach[other])
        if fits.any():
            yield np.unique(own[some[fits]] * len(k) + own[other[fits]])
        at = stop


def cluster_pairs(n: np.ndarray, component: np.ndarray, differences: list[np.ndarray], similarity) -> tuple[np.ndarray, ...]:
    """(member, member, sure) of the members of a cluster that may be similar across components, as far as others don't join these surely."""
    t, whole = similarity
    unit = 2 * (whole + t)
    d = np.array([len(x) for x in differences], np.int64)
    k = (whole + t) * d - (whole - t) * n
    own = np.repeat(np.arange(len(d)), d)
    token = np.unique(np.concatenate(differences), return_inverse=True)[1].reshape(-1) if len(own) else np.zeros(0, np.int64)
    names, component = np.unique(component, return_inverse=True)
    boss = list(range(len(names)))

    def root(x):
        while boss[x] != x:
            boss[x] = boss[boss[x]]
            x = boss[x]
        return x

    out = []
    # that these share nothing is enough; by whole hashes they have the center's component, halved ones may say otherwise
    auto = np.flatnonzero(k + k.min(initial=0) <= 0)
    if len(np.unique(component[auto])) > 1:
        for i in auto.tolist():
            out += [(i, int(j), False) for j in auto[(auto > i) & (component[auto] != component[i]) & (k[auto] + k[i] <= 0)]]
    for one in (True, False):
        now = np.array([root(x) for x in range(len(boss))])[component]
        met = postings(own, token, k, d, now, unit)
        for codes in meetings(*met, k, now, one):
            for i, j in zip((codes // len(k)).tolist(), (codes % len(k)).tolist(), strict=True):
                x, y = root(component[i]), root(component[j])
                if x == y:
                    continue
                left = unit * _common(differences[i], differences[j]) - int(k[i] + k[j])
                if left >= 0:
                    sure = bool(left >= unit * doubt(n[i], n[j]))
                    out.append((i, j, sure))
                    if sure:
                        boss[y] = x
    return tuple(np.array([x[p] for x in out], np.int64) for p in range(3))


FOUND = "a bigint, b bigint, sure boolean"


def _in_tasks(rows: DataFrame, similarity) -> DataFrame:
    """FOUND of clusters g that fit a task each; rows (g, b, n, null, blob) and (g, b, null, c, null)."""

    def solved(components, members):
        ids = np.array([b for b, _, _ in members], np.int64)
        found = cluster_pairs(np.array([n for _, n, _ in members], np.int64), np.array([components[b] for b, _, _ in members], np.int64), [np.frombuffer(x, np.uint32) for _, _, x in members], similarity)
        return pa.RecordBatch.from_arrays([pa.array(ids[found[0]]), pa.array(ids[found[1]]), pa.array(found[2] > 0)], ["a", "b", "sure"])

    def run(batches):
        at, components, members = None, {}, []
        for batch in batches:
            for g, b, n, c, blob in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if g != at:
                    if members:
                        yield solved(components, members)
                    at, components, members = g, {}, []
                if blob is None:
                    components[b] = c
                else:
                    members.append((b, n, blob))
        if members:
            yield solved(components, members)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "g").sortWithinPartitions("g").mapInArrow(released(run), FOUND)


def _spread(rows: DataFrame, one: bool, similarity) -> DataFrame:
    """Pairs (a, b) of members of large clusters that may be similar: as in `cluster_pairs`, by tables; rows (g, b, c, k, d, blob)."""
    t, whole = similarity
    unit = 2 * (whole + t)

    def told(batches):
        for batch in batches:
            x = [np.frombuffer(blob, np.uint32) for blob in batch.column(5).to_pylist()]
            many = batch.select(range(5)).take(pa.array(np.repeat(np.arange(len(x)), [len(y) for y in x])))
            yield pa.RecordBatch.from_arrays([*many.columns, pa.array(np.concatenate([np.zeros(0), *x]).astype(np.int64))], ["g", "b", "c", "k", "d", "x"])

    schema = T.StructType(rows.select("g", "b", "c", "k", "d").schema.fields + [T.StructField("x", T.LongType())])
    held = rows.select("g", "b", "c", "k", "d", "blob").mapInArrow(told, schema)
    met = held.groupBy("g", "x").agg(F.count("*").alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("g", "x", "n")
    ranked = held.join(met, ["g", "x"]).groupBy("g", "b", "c", "k", "d").agg(F.array_sort(F.collect_list(F.struct("n", "x"))).alias("xs"))
    ahead = F.col("d") - F.size("xs") + F.col("pos")
    ranked = ranked.select("g", "b", "c", "k", "d", "xs", F.posexplode("xs").alias("pos", "e")).select("g", "b", "c", "k", F.col("e.x").alias("x"), (unit * (F.col("d") - ahead) - F.col("k")).alias("reach"))
    least = ranked.groupBy("g", "x").agg(F.min(F.struct("k", "b", "c", "reach")).alias("m"))
    ranked = cut(ranked.join(least, ["g", "x"]).where("reach >= m.k"), "postings")
    if one:
        return ranked.where("c <> m.c and k <= m.reach").select("b", F.col("m.b").alias("a")).distinct().select("a", "b")
    x, y = ranked.drop("m").alias("x"), ranked.drop("m").alias("y")
    meets = (F.col("x.g") == F.col("y.g")) & (F.col("x.x") == F.col("y.x")) & (F.col("x.c") < F.col("y.c")) & (F.col("x.k") <= F.col("y.reach")) & (F.col("y.k") <= F.col("x.reach"))
    zero, nought = rows.select("g", "b", "c", "k"), rows.groupBy("g").agg(F.min("k").alias("low"))
    zero = cut(zero.join(nought, "g").where("k + low <= 0").drop("low"), "auto")
    split = zero.groupBy("g").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("g")
    zero = zero.join(split, "g", "left_semi")
    p, q = zero.alias("p"), zero.alias("q")
    apart = p.join(q, (F.col("p.g") == F.col("q.g")) & (F.col("p.c") < F.col("q.c")) & (F.col("p.k") + F.col("q.k") <= 0))
    return x.join(y, meets).select(F.col("x.b").alias("a"), F.col("y.b").alias("b")).unionByName(apart.select(F.col("p.b").alias("a"), F.col("q.b").alias("b"))).distinct()


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """`found` (id, component) after more `links` (a, b): what they join are components, which are contracted."""
    own = found.select(F.col("id").alias("own"), "component")
    edges = links.join(own.withColumnsRenamed({"own": "a", "component": "x"}), "a", "left").join(own.withColumnsRenamed({"own": "b", "component": "y"}), "b", "left")
    steps = components(edges.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")))
    every = found.unionByName(steps.select("id", F.col("id").alias("component"))).distinct()
    steps = steps.select(F.col("id").alias("component"), F.col("component").alias("least"))
    return cut(every.join(steps, "component", "left").select("id", F.coalesce("least", "component").alias("component")), "components", keep=True)


def linked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, similarity=SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles) of every row, and (id, component) of every document that has a link."""
    with small_batches(docs.sparkSession), scratch(docs.sparkSession):
        return _linked(docs, doc_id, text, words, similarity)


def _linked(docs: DataFrame, doc_id: str, text: str, words: int, similarity) -> tuple[DataFrame, DataFrame]:
    n = partitions(docs)
    buckets = 2 * n
    narrow = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("t"))
    found = narrow.mapInArrow(released(_messages(buckets, words, similarity)), ROW).repartition(n, "bucket").mapInArrow(released(_groups(HOT, similarity, n)), ROW)
    found = cut(found, "groups", keep=True)
    sizes = _rows(found, "sizes", "doc_id bigint, n_shingles bigint")
    twins = _rows(found, "links", "a bigint, b bigint")
    load = _rows(found, "load", "id bigint, band bigint, n bigint, free bigint").groupBy("id", "band").agg(F.sum("n").alias("n"), F.min("free").alias("free"))
    bound = cut(load.where("n >= free").select(F.col("id").alias("b"), "band"), "bound")
    if bound.count() <= MAX_BROADCAST_IDS:
        bound = F.broadcast(bound)
    stars = cut(_stars(found, n), "pairs")
    large = stars.where(F.col("band") != NO_BAND).join(bound, ["b", "band"], "left_semi")
    stars = cut(stars.where(F.col("band") == NO_BAND).select("a", "b", "f").unionByName(large.select("a", "b", "f")).groupBy("a", "b").agg(F.bit_or("f").alias("f")), "stars")
    sets = _set_table(docs, _ends(stars), doc_id, text, words, True)
    compared = cut(_compared(stars, sets, True, similarity), "compared").withColumn("g", F.struct("a", "v"))
    alike = compared.where("similar")
    links = alike.where("sure").select("a", "b").unionByName(verified(alike.where("not sure"), docs, doc_id, text, words, similarity))
    first = components(twins.unionByName(links))
    # what the links to the centers left apart; small clusters are done at once, large ones by the least k before all that is left
    wide = compared.where("many")
    for one in (True, False):
        own = first.select(F.col("id").alias("b"), F.col("component").alias("c"))
        members = wide.select("g", "b", "d").join(own, "b", "left").select("g", "b", "d", F.coalesce("c", "b").alias("c"))
        clusters = members.groupBy("g").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.sum("d").alias("tokens")).where("lo < hi")
        clusters = cut(clusters.select("g", (F.col("tokens") > CLUSTER_TOKENS).alias("large")), "clusters")
        count = {r.large: r["count"] for r in clusters.groupBy("large").count().collect()}
        found = []
        for large in (False, True):
            if not count.get(large) or not (one or large):
                continue
            some = clusters.where(F.col("large") == large).select("g")
            some = F.broadcast(some) if count[large] <= MAX_BROADCAST_IDS else some
            held, told = wide.join(some, "g", "left_semi"), members.join(some, "g", "left_semi")
            if large:
                found.append(_spread(cut(held.select("g", "b", "k", "d", "blob").join(told.select("g", "b", "c").distinct(), ["g", "b"]), "large"), one, similarity).withColumn("sure", F.lit(False)))
            else:
                held = held.select("g", "b", "n", F.lit(None).cast("bigint").alias("c"), "blob")
                told = told.select("g", "b", F.lit(None).cast("bigint").alias("n"), "c", F.lit(None).cast("binary").alias("blob"))
                found.append(_in_tasks(held.unionByName(told), similarity))
        if not found:
            break
        pairs = cut(found[0] if len(found) == 1 else found[0].unionByName(found[1]), "pairs")
        if not pairs.isEmpty():
            links = verified(pairs.where("not sure"), docs, doc_id, text, words, similarity)
            first = _joined(first, pairs.where("sure").select("a", "b").unionByName(links))
        if not count.get(True):
            break
    return sizes, first


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, similarity=SIMILARITY) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: component_id is the least id that links reach, itself included."""
    sizes, found = linked(docs, doc_id, text, words, similarity)
    own = F.when(F.col("doc_id") != NO_ID, F.col("doc_id"))
    return sizes.join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left").select(own.alias("doc_id"), "n_shingles", F.coalesce("component", own).alias("component_id"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` whose document is the least of its component; rows without id all stay."""
    _, found = linked(docs, doc_id, text)
    gone = found.where("id <> component").select(F.col("id").alias(doc_id))
    if gone.count() <= MAX_BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, doc_id, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
