"""Removal of repeated passages by a hash-compared suffix sort.

Every byte that lies in a `length`-byte string which starts earlier too (in a document of smaller id, or earlier in the
same one) is removed; strings are judged on the input.

Equal strings have to meet in one task without a shuffle of every suffix. Each window of `length` bytes chooses the
least hash among its GRAM-byte substrings (its anchor), which equal windows choose alike; consecutive windows share anchors,
so one record stands for some 35 suffixes. First only anchor hashes travel, to find those that stand in two blocks of
documents; then the records of repeated anchors bring the bytes of their windows to the task of their hash. There,
suffixes with the same anchor and offset are merge sorted: prefix polynomial hashes and a binary search find the common
extension of two suffixes, so a comparison takes logarithmic time; neighbours in that order that agree in `length`
bytes by hash are compared byte by byte, and a group in which that fails (a collision) is sorted by its bytes instead.
Of each class the earliest keeps its bytes. Records that agree within a block are settled there and sent once, so that a
passage in a third of all documents arrives once a block; and suffixes whose first bytes hash like no other's are left out of the sort.

Null and empty texts and texts below `length` bytes lose nothing. Rows without id come after all others; rows of equal
id, repeated rows among them, count as separate documents in the order in which they are read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakesieve.llm import _bytes
from lakesieve.llm._blocks import NO_ID, answered, block_of, blocks_of, pack, rest_of, rows_of, unpack
from lakesieve.llm._bytes import U64, Texts, cuts, mix, powers, prefix_hash, span_hash
from lakesieve.llm._spark import cut, partitions, released, small_batches

LENGTH = 100
#: Bytes of an anchor; a window's offset to its anchor must fit 7 bits.
GRAM = 32
SPREAD = U64(0xA0761D6478BD642F)
#: Windows that are hashed at once.
PIECE = 1 << 17
#: Bytes of records that are sorted at once.
PART_BYTES = 1 << 19


def anchors(texts: Texts, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(hash, anchor, first window, last window) of each run of windows that choose the same anchor; starts are in texts.data."""
    n, span = len(texts.data), length - gram + 1
    if not 0 < span <= 128:
        raise ValueError("a window's offset to its anchor must fit 7 bits")
    parts = []
    for low in range(0, max(n - length + 1, 0), PIECE):
        hashes, least = _least(texts.data[low : low + PIECE + length - 1], gram, span)
        stop = texts.offs[np.searchsorted(texts.offs, np.arange(low, low + len(least)), "right")]
        starts = np.flatnonzero(np.arange(low, low + len(least)) + length <= stop)
        at = starts + (least[starts] & U64(127)).astype(np.int64)
        turn = np.flatnonzero(at[1:] != at[:-1]) + 1
        first = np.concatenate(([0], turn))[: len(at)]
        last = np.concatenate((turn - 1, [len(at) - 1]))[: len(at)]
        run = [hashes[at[first]], at[first] + low, starts[first] + low, starts[last] + low]
        if parts and len(at) and len(parts[-1][1]) and parts[-1][1][-1] == run[1][0]:  # a run that goes on here
            parts[-1][3][-1] = run[3][0]
            run = [x[1:] for x in run]
        parts.append(run)
    none = np.zeros(0, np.int64)
    hashes, at, first, last = (np.concatenate([none.astype(U64) if k == 0 else none, *(p[k] for p in parts)]) for k in range(4))
    return mix(hashes ^ SPREAD), at, first, last  # least hashes crowd at the low end


def _least(data: np.ndarray, gram: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all substrings of `gram` bytes; per window of `span` of them the least, with its offset in the low 7 bits."""
    prefix = prefix_hash(data)
    hashes = mix((prefix[gram:] - prefix[:-gram]) * powers(_bytes.INVERSE, len(data) - gram + 1))
    least, have = hashes & ~U64(127), 1
    while have < span:
        step = min(have, span - have)
        least = np.minimum(least[:-step], least[step:] + U64(step))
        have += step
    return hashes, least


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether data[a:a+length] and data[b:b+length] agree, for each triple."""
    out = np.ones(len(a), bool)
    limit = 1 << 22
    ends = np.cumsum(lengths)
    i = 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + limit, "right")))
        size = lengths[i:j]
        firsts = np.concatenate(([0], np.cumsum(size)[:-1]))
        inner = np.arange(int(size.sum())) - np.repeat(firsts, size)
        same = data[np.repeat(a[i:j], size) + inner] == data[np.repeat(b[i:j], size) + inner]
        out[i:j] = np.logical_and.reduceat(same, firsts)
        i = j
    return out


class Suffixes:
    """Suffixes of `data`, compared in their first `length` bytes."""

    def __init__(self, data: np.ndarray, length: int):
        self.data, self.length = data, length
        self.prefix, self.inverse = prefix_hash(data), powers(_bytes.INVERSE, len(data) + 1)

    def equal(self, a: np.ndarray, b: np.ndarray, n) -> np.ndarray:
        p = self.prefix
        return (p[a + n] - p[a]) * self.inverse[a] == (p[b + n] - p[b]) * self.inverse[b]

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many bytes the suffixes at a and b have in common, `length` at most."""
        lo, hi = np.zeros(len(a), np.int64), np.full(len(a), self.length)
        while (open_ := lo < hi).any():
            mid = np.where(open_, (lo + hi + 1) >> 1, lo)
            same = self.equal(a, b, mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, np.maximum(mid - 1, lo))
        return lo

    def below(self, a: np.ndarray, b: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether the suffix at a comes before that at b; equal ones give `ties`."""
        out = ties.copy()
        differ = np.flatnonzero(~self.equal(a, b, self.length))
        if len(differ):
            x, y = a[differ], b[differ]
            common = np.minimum(self.extension(x, y), self.length - 1)
            out[differ] = self.data[x + common] < self.data[y + common]
        return out

    def merge_sort(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Orders the suffixes `at` within each run of equal `group` numbers; gives the order of indices."""
        order = np.arange(len(at))
        if not len(at):
            return order
        begin = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        size = np.diff(np.concatenate((begin, [len(at)])))
        base, room = np.repeat(begin, size), np.repeat(size, size)
        place = order - base
        width = 1
        while width < size.max():
            act = np.flatnonzero(room > width)
            local, start, most = place[act], base[act], room[act]
            run = local // width
            other = np.minimum((run ^ 1) * width, most)
            stop = np.minimum(other + width, most)
            left = run % 2 == 0
            lo, hi = start + other, start + stop
            first = lo.copy()
            own = at[order[act]]
            while (busy := np.flatnonzero(lo < hi)).size:
                mid = (lo[busy] + hi[busy]) >> 1
                # elements of the right run go behind equal ones of the left
                less = self.below(at[order[mid]], own[busy], ~left[busy])
                lo[busy] = np.where(less, mid + 1, lo[busy])
                hi[busy] = np.where(less, hi[busy], mid)
            to = start + (run >> 1) * 2 * width + local % width + (lo - first)
            new = order.copy()
            new[to] = order[act]
            order = new
            width *= 2
        return order


def classes(data: np.ndarray, at: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, class number in that order): suffixes of a group are in a class if their first `length` bytes agree."""
    suffixes = Suffixes(data, length)
    order = suffixes.merge_sort(at, group)
    if not len(at):
        return order, order
    x, y = at[order[:-1]], at[order[1:]]
    linked = (group[:-1] == group[1:]) & suffixes.equal(x, y, length)
    pairs = np.flatnonzero(linked)
    rows = np.lib.stride_tricks.sliding_window_view(data, length)
    real = np.concatenate([np.zeros(0, bool), *((rows[x[p]] == rows[y[p]]).all(axis=1) for p in np.array_split(pairs, 1 + len(pairs) // 50_000))])
    broken = np.unique(group[pairs[~real]])
    label = np.concatenate(([0], np.cumsum(~linked)))
    for g in broken.tolist():  # a collision: by the bytes themselves
        lo, hi = np.searchsorted(group, [g, g + 1])
        keyed = sorted((data[at[i] : at[i] + length].tobytes(), i) for i in range(lo, hi))
        order[lo:hi] = [i for _, i in keyed]
        fresh = [k == 0 or keyed[k][0] != keyed[k - 1][0] for k in range(len(keyed))]
        label[lo:hi] = len(at) * (1 + g) + np.cumsum(fresh)
    return order, label


def _hash_messages(buckets: int, length: int):
    """Each block's distinct anchor hashes, by bucket."""

    def run(batches):
        for row in rows_of(batches, "block", "ids", "offs", "raw"):
            number, _, texts = block_of(row)
            hashes = np.unique(anchors(texts, length)[0])
            at = cuts(hashes, buckets).tolist()
            full = [b for b in range(buckets) if at[b + 1] > at[b]]
            blobs = [pack(hashes[at[b] : at[b + 1]]) for b in full]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([number] * len(full), pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "block", "blob"])

    return run


def _by_bucket(batches) -> dict[int, list[tuple[int, bytes]]]:
    held: dict[int, list[tuple[int, bytes]]] = {}
    for row in rows_of(batches):
        held.setdefault(row["bucket"], []).append((row["block"], row["blob"]))
    return held


def _answers(by_block: dict[int, list[bytes]]):
    blocks = [(b, blob) for b, blobs in by_block.items() for blob in blobs]
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in blocks], pa.int64()), pa.array([x for _, x in blocks], pa.binary())], ["block", "blob"])


def _shared_hashes(batches):
    """For each block, those of its hashes that another block has too."""
    for of in _by_bucket(batches).values():
        parts = [unpack(blob)[0] for _, blob in of]
        hashes, owner = np.concatenate(parts), np.repeat(np.arange(len(of)), [len(p) for p in parts])
        order = np.argsort(hashes, kind="stable")
        ordered = hashes[order]
        same = ordered[1:] == ordered[:-1]
        shared = np.zeros(len(hashes), bool)
        shared[order[1:]] |= same
        shared[order[:-1]] |= same
        out: dict[int, list[bytes]] = {}
        chosen, by = hashes[shared], owner[shared]
        ends = np.searchsorted(by, np.arange(len(of) + 1)).tolist()
        for k in range(len(of)):
            if ends[k + 1] > ends[k]:
                out[of[k][0]] = [pack(chosen[ends[k] : ends[k + 1]])]
        if out:
            yield _answers(out)


def _member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values stand in the sorted table."""
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def _runs(docs: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Maximal runs of the intervals of each document."""
    if not len(docs):
        return docs, starts, ends
    order = np.lexsort((starts, docs))
    docs, starts, ends = docs[order], starts[order], ends[order]
    wide = int(max(ends.max(), 1)) + 1
    reach = np.maximum.accumulate(ends + docs * wide)
    fresh = np.concatenate(([True], (starts + docs * wide)[1:] > reach[:-1]))
    first = np.flatnonzero(fresh)
    last = np.concatenate((first[1:] - 1, [len(docs) - 1]))
    return docs[first], starts[first], reach[last] - docs[last] * wide


def _followers(data: np.ndarray, hashes: np.ndarray, back: np.ndarray, first: np.ndarray, lengths: np.ndarray, rank: tuple) -> np.ndarray:
    """Records that agree in anchor, offset and all bytes with one that `rank` (least significant first) puts before them."""
    key = mix(span_hash(prefix_hash(data), first, first + lengths) + back.astype(U64)) ^ hashes
    order = np.argsort(key, kind="stable")
    twice = key[order][1:] == key[order][:-1]
    some = order[np.concatenate(([False], twice)) | np.concatenate((twice, [False]))]
    order = some[np.lexsort((*(r[some] for r in rank), key[some]))]
    head = np.concatenate(([True], key[order][1:] != key[order][:-1]))[: len(order)]
    lead, follow = order[np.flatnonzero(head)[np.cumsum(head) - 1]], np.flatnonzero(~head)
    mine, theirs = order[follow], lead[follow]
    alike = (lengths[mine] == lengths[theirs]) & (back[mine] == back[theirs]) & (hashes[mine] == hashes[theirs])
    return mine[alike & same_bytes(data, first[mine], first[theirs], np.where(alike, lengths[mine], 1))]


def _repeated(hashes: np.ndarray) -> np.ndarray:
    distinct, counts = np.unique(hashes, return_counts=True)
    return ~_member(hashes, distinct[counts == 1])


def _context_messages(buckets: int, length: int):
    """Of each block, the records whose anchor stands elsewhere too, by bucket; and what the block settles by itself."""

    def run(batches):
        for row in rows_of(batches):
            number, ids, texts = block_of(row)
            elsewhere = np.sort(np.concatenate([np.zeros(0, U64), *(unpack(b)[0] for b in row["answers"] or ())]))
            hashes, at, first, last = anchors(texts, length)
            pick = np.flatnonzero(_member(hashes, elsewhere) | _repeated(hashes))
            if not len(pick):
                continue
            hashes, at, first, last = hashes[pick], at[pick], first[pick], last[pick]
            docs = np.searchsorted(texts.offs, first, "right") - 1
            rank = np.empty(len(ids), np.int64)
            rank[np.argsort(ids, kind="stable")] = np.arange(len(ids))
            lengths = last - first + length
            settled = _followers(texts.data, hashes, at - first, first, lengths, (first, rank[docs]))
            if len(settled):
                done = _runs(docs[settled], first[settled] - texts.offs[docs[settled]], first[settled] + lengths[settled] - texts.offs[docs[settled]])
                yield pa.RecordBatch.from_arrays([pa.array([number % buckets], pa.int32()), pa.array([number], pa.int64()), pa.array([True]), pa.array([pack(*done)], pa.binary())], MESSAGE)
            rest = np.setdiff1d(np.arange(len(pick)), settled)
            rest = rest[_member(hashes[rest], elsewhere) | _repeated(hashes[rest])]
            rest = rest[np.argsort(hashes[rest], kind="stable")]
            edges = cuts(hashes[rest], buckets).tolist()
            for b in range(buckets):
                some = rest[edges[b] : edges[b + 1]]
                if len(some):
                    size = lengths[some]
                    firsts = np.concatenate(([0], np.cumsum(size)[:-1]))
                    body = texts.data[np.arange(int(size.sum())) + np.repeat(first[some] - firsts, size)]
                    doc = docs[some]
                    blob = pack(hashes[some], ids[doc], doc.astype(np.uint32), (first[some] - texts.offs[doc]), (at[some] - first[some]).astype(np.uint8), (last[some] - first[some] + 1).astype(np.uint8), body)
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([number], pa.int64()), pa.array([False]), pa.array([blob], pa.binary())], MESSAGE)

    return run


MESSAGE = ["bucket", "block", "settled", "blob"]


def _sorted_suffixes(length: int):
    """The suffix sort of each bucket: for each block, the runs that its documents lose."""

    def run(batches):
        held: dict[int, list[tuple[int, bytes]]] = {}
        for row in rows_of(batches):
            if row["settled"]:
                yield _answers({row["block"]: [row["blob"]]})
            else:
                held.setdefault(row["bucket"], []).append((row["block"], row["blob"]))
        while held:
            _, of = held.popitem()
            of.sort()
            for owner, hashes, ids, docs, first, back, count, body in _by_range([unpack(blob) for _, blob in of], length):
                out = _lost(owner, hashes, ids, docs, first, back, count, body, length, [number for number, _ in of])
                if out:
                    yield _answers(out)

    return run


def _by_range(parts: list[list[np.ndarray]], length: int):
    """The records of all parts, as many anchor hashes at a time as have about PART_BYTES of text, with the part of each."""
    held = sum(len(p[-1]) for p in parts)
    every = np.sort(np.concatenate([p[0] for p in parts]))
    number = max(1, held // PART_BYTES)
    bounds = np.unique(every[np.arange(1, number) * len(every) // number])
    edges = [np.concatenate(([0], np.searchsorted(p[0], bounds), [len(p[0])])) for p in parts]
    offs = [np.concatenate(([0], np.cumsum(p[5].astype(np.int64) + length - 1))) for p in parts]
    for k in range(len(bounds) + 1):
        some = [(i, int(e[k]), int(e[k + 1])) for i, e in enumerate(edges) if e[k + 1] > e[k]]
        if not some:
            continue
        owner = np.repeat([i for i, _, _ in some], [hi - lo for _, lo, hi in some])
        columns = [np.concatenate([parts[i][c][lo:hi] for i, lo, hi in some]) for c in range(6)]
        body = np.concatenate([parts[i][6][offs[i][lo] : offs[i][hi]] for i, lo, hi in some])
        yield owner, *(c if j < 2 else c.astype(np.int64) for j, c in enumerate(columns)), body


def _lost(owner, hashes, ids, docs, first, back, count, body, length: int, blocks: list[int]) -> dict[int, list[bytes]]:
    """For each block, the runs that its documents lose by the records at hand."""
    sizes = count + length - 1
    base = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    same = _followers(body, hashes, back, base, sizes, (first, docs, owner, ids))
    alone = np.setdiff1d(np.arange(len(count)), same)
    alone = alone[_repeated(hashes[alone])]
    record = np.repeat(alone, count[alone])
    step = np.arange(len(record)) - np.repeat(np.cumsum(count[alone]) - count[alone], count[alone])
    key = mix(hashes[record] + (back[record] - step).astype(U64) * U64(0x9E3779B97F4A7C15))
    # equal strings have equal hashes: a suffix whose first `length` bytes hash like no other's needs no place in the order
    at = base[record] + step
    held = _repeated(mix(span_hash(prefix_hash(body), at, at + length) + key))
    record, step, key = record[held], step[held], key[held]
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    near = np.concatenate(([False], ordered[1:] == ordered[:-1], [False]))
    many = order[(near[1:] | near[:-1])[: len(order)]]
    record, step, key = record[many], step[many], key[many]
    group = np.cumsum(np.concatenate(([0], key[1:] != key[:-1])))[: len(key)]
    order, label = classes(body, base[record] + step, group, length)
    record, step = record[order], step[order]
    _, label = np.unique(label, return_inverse=True)
    rank = np.lexsort((first[record] + step, docs[record], owner[record], ids[record], label))
    head = np.concatenate(([True], label[rank][1:] != label[rank][:-1]))[: len(rank)]
    lost = rank[~head]
    starts = np.concatenate((first[record[lost]] + step[lost], first[same]))
    stops = np.concatenate((first[record[lost]] + step[lost] + length, first[same] + sizes[same]))
    record = np.concatenate((record[lost], same))
    by = np.argsort(owner[record], kind="stable")
    record, starts, stops = record[by], starts[by], stops[by]
    ends = np.searchsorted(owner[record], np.arange(len(blocks) + 1)).tolist()
    out: dict[int, list[bytes]] = {}
    for k, number in enumerate(blocks):
        some = slice(ends[k], ends[k + 1])
        if ends[k + 1] > ends[k]:
            out.setdefault(number, []).append(pack(*_runs(docs[record[some]], starts[some], stops[some])))
    return out


def lost_runs(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of the runs that a block's documents lose."""
    parts = [unpack(b) for b in row["answers"] or ()]
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, none
    return _runs(*(np.concatenate(x).astype(np.int64) for x in zip(*parts, strict=True)))


def answered_blocks(df: DataFrame, doc_id: str, text: str, length: int, rest: list[str] | None) -> DataFrame:
    """Blocks with the runs that their documents lose."""
    n = partitions(df)
    buckets = 2 * n
    blocks = blocks_of(df, doc_id, text, rest=rest)
    asked = blocks.mapInArrow(released(_hash_messages(buckets, length)), "bucket int, block bigint, blob binary")
    shared = asked.repartition(n, "bucket").mapInArrow(released(_shared_hashes), "block bigint, blob binary")
    sent = answered(blocks, shared).mapInArrow(released(_context_messages(buckets, length)), "bucket int, block bigint, settled boolean, blob binary")
    runs = sent.repartition(n, "bucket").mapInArrow(released(_sorted_suffixes(length)), "block bigint, blob binary")
    return answered(blocks, runs)


def dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """A row for each document: doc_id, n_bytes, spans (start and end byte of each removed run) and kept_sha256."""

    def run(batches):
        for row in rows_of(batches):
            _, ids, texts = block_of(row)
            docs, starts, ends = lost_runs(row)
            at = np.searchsorted(docs, np.arange(len(ids) + 1)).tolist()
            raw, offs = texts.data.tobytes(), texts.offs.tolist()
            spans, kept = [], []
            for i in range(len(ids)):
                own = raw[offs[i] : offs[i + 1]]
                runs = list(zip(starts[at[i] : at[i + 1]].tolist(), ends[at[i] : at[i + 1]].tolist(), strict=True))
                spans.append(runs)
                kept.append(hashlib.sha256(keep(own, runs)).hexdigest())
            columns = [pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(np.diff(texts.offs)), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(kept)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "spans", "kept_sha256"])

    with small_batches(df.sparkSession):
        return cut(answered_blocks(df, doc_id, text, length, []).mapInArrow(released(run), "doc_id bigint, n_bytes bigint, spans array<array<bigint>>, kept_sha256 string"), "spans")


def keep(raw: bytes, runs) -> bytes:
    at, out = 0, []
    for start, end in runs:
        out.append(raw[at:start])
        at = end
    out.append(raw[at:])
    return b"".join(out)


def dedup_documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, n_chars: str | None = None) -> DataFrame:
    """The rows of `df` with what is left of their texts; documents of which nothing is left go, those that had no text stay.

    A cut through a character of several bytes drops the rest of that character. `n_chars` names a column that holds
    the text's length and follows it.
    """
    rest = [c for c in df.columns if c not in (doc_id, text)]
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])

    def run(batches):
        for row in rows_of(batches):
            _, ids, texts = block_of(row)
            docs, starts, ends = lost_runs(row)
            other, raw, offs = rest_of(row["rest"]), texts.data, texts.offs
            inside = np.zeros(len(raw) + 1, np.int64)
            np.add.at(inside, starts + offs[docs], 1)
            np.add.at(inside, ends + offs[docs], -1)
            stay = np.cumsum(inside[:-1]) == 0
            left = texts.sums(stay)
            whole, at = raw[stay].tobytes(), np.concatenate(([0], np.cumsum(left))).tolist()
            strings = [whole[at[i] : at[i + 1]].decode("utf-8", "ignore") for i in range(len(ids))]
            alive = (left > 0) | (np.diff(offs) == 0)
            columns = {doc_id: pa.array(ids, pa.int64(), mask=ids == NO_ID), text: pa.array(strings)}
            for c in rest:
                columns[c] = other[c].combine_chunks()
            if n_chars:
                columns[n_chars] = pa.array([len(s) for s in strings], other[n_chars].type)
            yield pa.RecordBatch.from_arrays([columns[c] for c in df_names], df_names).filter(pa.array(alive))

    df_names = df.columns
    with small_batches(df.sparkSession):
        return cut(answered_blocks(df, doc_id, text, length, rest).mapInArrow(released(run), schema), "left")


def measures() -> list:
    """n_removed and n_spans from `spans`."""
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, r: s + r[1] - r[0])
    return [removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans")]
