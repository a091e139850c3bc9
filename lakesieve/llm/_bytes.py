"""Whole texts as one byte array: rolling hashes, words and per-document sums, all with numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Documents are handled in chunks of about so many bytes; a longer document is a chunk by itself.
CHUNK_BYTES = 2 << 20

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if len(have) <= 2 * CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """p with p[j] - p[i] = sum of values[k] * BASE**k over i <= k < j."""
    out = np.empty(len(values) + 1, U64)
    out[0] = 0
    np.cumsum((values.astype(U64) + U64(1)) * powers(BASE, len(values)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of values[start:end] that does not depend on where they stand."""
    return (prefix[end] - prefix[start]) * powers(INVERSE, len(prefix))[start]


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets 0 .. buckets-1 in the order of the keys."""
    return ((keys >> U64(32)) * U64(buckets)) >> U64(32)


def cuts(sorted_keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket starts in sorted keys; one more for the end."""
    firsts = [-(-(b << 32) // buckets) << 32 for b in range(buckets)]
    return np.append(np.searchsorted(sorted_keys, np.array(firsts, U64)), len(sorted_keys))


@dataclass
class Texts:
    """Documents side by side: document i is data[offs[i]:offs[i + 1]]."""

    data: np.ndarray
    offs: np.ndarray

    def __len__(self) -> int:
        return len(self.offs) - 1

    def sums(self, flags: np.ndarray) -> np.ndarray:
        """Per document, the sum of one value a byte."""
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[self.offs[1:]] - total[self.offs[:-1]]

    def lowered(self) -> Texts:
        return Texts(np.frombuffer(self.data.tobytes().translate(LOWER), np.uint8), self.offs)

    def words(self, ink: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words `[^\\x20\\x09-\\x0D]+` (or of those that `ink` marks), and where each document's words begin."""
        edge = np.zeros(len(self.data) + 1, bool)
        ink = ~WHITE[self.data] if ink is None else ink
        edge[self.offs] = True
        before = np.concatenate(([False], ink))
        after = np.concatenate((ink, [False]))
        starts = np.flatnonzero(after & (~before | edge))
        ends = np.flatnonzero(before & (~after | edge))
        return starts, ends, np.searchsorted(starts, self.offs)


def texts_of(column: pa.Array) -> Texts:
    """A string or binary column (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.cast(pa.binary() if pa.types.is_binary(column.type) or pa.types.is_string(column.type) else pa.large_binary()).fill_null(b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    if not len(column):
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return Texts(data, offs - offs[0])


def chunks(texts: Texts, limit: int = CHUNK_BYTES):
    """(first document, Texts) of consecutive documents with about `limit` bytes together."""
    i = 0
    while i < len(texts):
        j = int(np.searchsorted(texts.offs, texts.offs[i] + limit, "right")) - 1
        j = min(max(j, i + 1), len(texts))
        yield i, Texts(texts.data[texts.offs[i] : texts.offs[j]], texts.offs[i : j + 1] - texts.offs[i])
        i = j


#: Spans of up to so many bytes are hashed side by side, longer ones one by one.
SIDE_BY_SIDE = 64
STEP = U64(0xD6E8FEB86659FD93)
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)


def span_digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], eight bytes a step and mixed after each: no polynomial, which some texts make collide for certain."""
    lengths = ends - starts
    out = mix(lengths.astype(U64) + STEP)
    wide = np.lib.stride_tricks.sliding_window_view(np.concatenate((data, np.zeros(8, np.uint8))), 8)
    for at in range(0, SIDE_BY_SIDE, 8):
        live = np.flatnonzero((lengths > at) & (lengths <= SIDE_BY_SIDE))
        if not len(live):
            break
        some = wide[starts[live] + at].view(U64).reshape(-1) & _MASKS[np.minimum(lengths[live] - at, 8)]
        out[live] = mix((out[live] ^ some) * STEP)
    for i in np.flatnonzero(lengths > SIDE_BY_SIDE).tolist():
        out[i] = xxhash.xxh3_64_intdigest(np.ascontiguousarray(data[starts[i] : ends[i]]), 1)
    return out


def word_hashes(texts: Texts, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_digests(texts.data, starts, ends)


def run_hashes(hashes: np.ndarray, at: np.ndarray, n: int | np.ndarray) -> np.ndarray:
    """Hashes of the runs hashes[at:at + n]; n is a number, or one for each run."""
    out, most = mix(hashes[at] + STEP), int(np.max(n, initial=0))
    for k in range(1, most):
        if isinstance(n, int):
            out = mix(out * STEP + hashes[at + k])
        else:
            live = np.flatnonzero(n > k)
            out[live] = mix(out[live] * STEP + hashes[at[live] + k])
    return out


def windows(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every n consecutive words within a document, and the index of each window's first word."""
    at = np.arange(max(len(hashes) - n + 1, 0))
    if len(at):
        left = np.repeat(first[1:], np.diff(first))[: len(at)]  # the end of the word's document
        at = at[at + n <= left]
    return run_hashes(hashes, at, n), at
