"""Documents in blocks of a few MB, which travel compressed and answer to messages from other blocks.

A block is a row: its number, the documents' ids, their texts and all other columns. What an operator asks about a block's
documents goes out in blobs by key bucket; answers come back by block number and are joined to the block, so each text
is shuffled once (Spark reuses the exchange) and no answer needs a row for each document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesieve.llm import _bytes
from lakesieve.llm._bytes import Texts, chunks, texts_of
from lakesieve.llm._spark import released

NO_ID = np.iinfo(np.int64).max
SCHEMA = "block bigint, ids binary, offs binary, raw binary, rest binary"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one dimension as bytes; equal high bytes of sorted numbers stand together and compress."""
    head, parts = [len(arrays)], []
    for a in arrays:
        head += [ord(a.dtype.char), len(a)]
        parts.append(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T).tobytes())
    return zstandard.compress(b"".join((np.array(head, np.int64).tobytes(), *parts)), 1)


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 2 * n, 8).tolist()
    at, out = 8 + 16 * n, []
    for char, length in zip(head[::2], head[1::2], strict=True):
        kind = np.dtype(chr(char))
        part = np.frombuffer(raw, np.uint8, length * kind.itemsize, at).reshape(kind.itemsize, length)
        out.append(np.ascontiguousarray(part.T).reshape(-1).view(kind))
        at += part.size
    return out


def blocks_of(df: DataFrame, doc_id: str, text: str, rest: list[str] | None = None, size: int | None = None) -> DataFrame:
    """`df` in blocks of about `size` (CHUNK_BYTES at most) bytes of text; `rest` (default: every other column) goes along."""
    rest = [c for c in df.columns if c not in (doc_id, text)] if rest is None else rest
    size = min(size or _bytes.CHUNK_BYTES, _bytes.CHUNK_BYTES)
    chosen = df.select(F.col(f"`{doc_id}`").cast("bigint"), F.col(f"`{text}`"), *[F.col(f"`{c}`") for c in rest])

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = texts_of(batch.column(1))
            known = np.asarray(batch.column(0).is_valid())
            ids = np.where(known, np.asarray(batch.column(0).fill_null(0)), NO_ID)
            for at, some in chunks(texts, size):
                part = batch.slice(at, len(some)).select(range(2, batch.num_columns)) if rest else None
                other = b"" if part is None else zstandard.compress(_ipc(part), 1)
                row = [number], [pack(ids[at : at + len(some)])], [pack(some.offs)], [zstandard.compress(some.data.tobytes(), 1)], [other]
                yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int64()), *(pa.array(x, pa.binary()) for x in row[1:])], SCHEMA_NAMES)
                number += 1

    return chosen.mapInArrow(released(run), SCHEMA)


SCHEMA_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def rest_of(raw: bytes) -> pa.Table | None:
    return pa.ipc.open_stream(zstandard.decompress(raw)).read_all() if raw else None


def block_of(row: dict) -> tuple[int, np.ndarray, Texts]:
    """(number, ids, texts) of a block's row."""
    return row["block"], unpack(row["ids"])[0], Texts(np.frombuffer(zstandard.decompress(row["raw"]), np.uint8), unpack(row["offs"])[0])


def rows_of(batches, *names: str):
    """Rows of record batches as dicts, one at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(n)[i].as_py() for n in names or batch.schema.names}


def answered(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """The blocks, each with the `answers` (block, blob) that it got."""
    own = answers.groupBy("block").agg(F.collect_list("blob").alias("answers")).hint("shuffle_hash")
    return blocks.join(own, "block", "left")
