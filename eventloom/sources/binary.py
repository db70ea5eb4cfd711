"""Binary session files: little-endian times, labels, features and waveforms.

Spark's binaryFile reader gives one file a row from any store; the parser turns it into rows in Arrow batches. Land the result in
Parquet once, and read that.

times: int64 values. labels: an int32 count of clusters, then an int32 a row. features: an int32 width, then int64 rows.
waves: int16 rows of samples x channels; a last row that isn't whole is dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "times": "path string, spike_idx bigint, t bigint",
    "labels": "path string, spike_idx bigint, label int",
    "features": "path string, spike_idx bigint, f array<bigint>",
    "waves": "path string, spike_idx bigint, wave array<smallint>",
}
ROWS = 50_000


def parse(kind: str, data: bytes, width: int = 0) -> tuple[np.ndarray, int]:
    """The values, a row for each event, and the width of a row (0: a scalar)."""
    if kind == "times":
        return np.frombuffer(data[: len(data) // 8 * 8], "<i8"), 0
    if kind == "labels":
        return np.frombuffer(data[4 : len(data) // 4 * 4], "<i4"), 0
    if kind == "features":
        width = int(np.frombuffer(data, "<i4", 1)[0])
        body = np.frombuffer(data, "<i8", (len(data) - 4) // 8, 4)
    elif kind == "waves":
        body = np.frombuffer(data[: len(data) // 2 * 2], "<i2")
    else:
        raise ValueError(f"no such kind: {kind}")
    return body[: len(body) // width * width].reshape(-1, width), width


def read_binary(spark: SparkSession, path: str, kind: str, width: int = 0) -> DataFrame:
    """Rows of the files at ``path``; ``width`` is samples x channels for waves."""
    schema = SCHEMAS[kind]
    names = [x.split()[0] for x in schema.split(", ")]
    types = {"times": pa.int64(), "labels": pa.int32(), "features": pa.int64(), "waves": pa.int16()}

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                values, wide = parse(kind, data, width)
                for i in range(0, len(values), ROWS):
                    part = values[i : i + ROWS]
                    flat = pa.array(part.ravel().astype(types[kind].to_pandas_dtype()), types[kind])
                    column = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * wide), flat) if wide else flat
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(i, i + len(part))), column], names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)
