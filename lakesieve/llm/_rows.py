"""Per-document measures added to a table by one pass over its texts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lakesieve.llm._bytes import Texts, chunks, texts_of
from lakesieve.llm._spark import released

ARROW = {"bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64(), "binary": pa.binary()}


def with_measures(df: DataFrame, text: str, fields: dict[str, str], measure: Callable[[Texts], dict], keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default: all) of `df` and the `fields` that `measure` finds in the column `text`.

    `measure` gets whole texts (null: empty) and gives a sequence for each field. Only the columns asked for travel.
    """
    keep = df.columns if keep is None else keep
    place = df.columns.index(text)
    chosen = [df.columns.index(c) for c in keep]
    schema = T.StructType([df.schema[i] for i in chosen])
    for name, kind in fields.items():
        schema = schema.add(name, T._parse_datatype_string(kind))

    def run(batches):
        for batch in batches:
            texts, parts = texts_of(batch.column(place)), []
            for _, some in chunks(texts):
                parts.append(measure(some))
            columns = [batch.column(i) for i in chosen]
            for name, kind in fields.items():
                values = [p[name] for p in parts]
                if values and isinstance(values[0], np.ndarray):
                    columns.append(pa.array(np.concatenate(values), ARROW[kind]))
                else:
                    columns.append(pa.array([x for v in values for x in v], ARROW[kind]))
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema])

    return df.mapInArrow(released(run), schema)
