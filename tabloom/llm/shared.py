"""Helpers of the llm operators: staged tables in the shared folder, folds, sizes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.session import ensure_checkpoint_dir

# A table is broadcast only when its measured size is at most this; beyond it
# the same join runs as a shuffle join.
BROADCAST_BYTES = 32 << 20


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the folder that all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage: a lost executor costs only the tasks that read the
    table, and values such as row ids are fixed from here on.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n`` (NULL for a null id)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(n)


def bounded(df: DataFrame, n_rows: int, row_bytes: int) -> DataFrame:
    """``df`` with a broadcast hint if ``n_rows`` rows of ``row_bytes`` are within the bound."""
    return F.broadcast(df) if n_rows * row_bytes <= BROADCAST_BYTES else df


# Python tasks work on slices of an Arrow batch of at most this many text bytes
# (a single longer text is a slice of its own).
SLICE_BYTES = 16 << 20


def text_slices(texts, limit: int = SLICE_BYTES):
    """(start, length) slices of a binary Arrow array, each of bounded bytes."""
    import numpy as np
    import pyarrow.compute as pc
    if not len(texts):
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo = 0
    while lo < len(size):
        base = size[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(size, base + limit, side="right")))
        yield lo, hi - lo
        lo = hi


def map_texts(df: DataFrame, text_col: str, carry: list[str], make, fields: T.StructType,
              limit: int = SLICE_BYTES) -> DataFrame:
    """Apply a text function to every row without a shuffle.

    ``make()`` runs once per task and returns a function from a list of texts (of about ``limit`` bytes together)
    (bytes, or None for null) to one list or Arrow array per field. The result
    has the columns ``row`` (a struct of ``carry``) and ``res`` (a struct of
    ``fields``), so no name can clash with the input's columns.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")
    inside = text_col in carry
    src = df.select(row) if inside else df.select(row, F.col(f"`{text_col}`").cast("binary").alias("text"))
    at = carry.index(text_col) if inside else None
    schema = T.StructType([T.StructField("row", src.schema["row"].dataType), T.StructField("res", fields)])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema
        arrow = to_arrow_schema(schema)
        fn, kind = None, arrow.field("res").type
        for batch in batches:
            texts = (batch.column(0).field(at) if inside else batch.column(1)).cast(pa.binary())
            for lo, n in text_slices(texts, limit):
                fn = fn or make()
                cols = fn(texts.slice(lo, n).to_pylist())
                arrays = [c if isinstance(c, pa.Array) and c.type == f.type else
                          c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type)
                          for c, f in zip(cols, kind)]
                res = pa.StructArray.from_arrays(arrays, fields=list(kind))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n).cast(arrow.field("row").type), res],
                                                 schema=arrow)
    return src.mapInArrow(run, schema)
