"""Embedding whitening on MLlib block matrices.

Every entry becomes an integer on a fixed grid. The rows are indexed into
distributed blocks, centred by the nearest integers to the column means, so
that products and their sums stay exact in doubles; what the rounding left is
taken off the covariance and the projections in closed form. The scatter is
the transposed block matrix times the block matrix, its middle dimension cut
into splits so that no task gets all rows; its eigenvectors are computed on
the driver (one matrix of dimension x dimension); the rows are projected by a
block matrix product with the whitening matrix. The error of the whitened
covariance is measured on the projected rows.
"""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.shared import stage

GRID = 64
OFFSET = 1_000_000
COMPONENTS = 32
BLOCK_ROWS = 1024
BLOCK_COLS = 1024
SPLIT_BYTES = 64 << 20          # row bytes of one split of the scatter's middle dimension
MAX_ENTRY = float(1 << 49)      # a larger entry has no exact place on the grid and counts as not finite


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(id, vec as doubles) of the rows to keep, and their dimension.

    Null vectors, empty ones and those with a null or non-finite entry go;
    of several lengths the commonest (then the longest) is the dimension.
    """
    df = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vec"))
    # NaN is larger than any number here.
    good = df.filter("vec is not null").filter(
        F.forall("vec", lambda v: F.coalesce(F.abs(v) < MAX_ENTRY, F.lit(False))) & (F.size("vec") > 0))
    sizes = good.groupBy(F.size("vec").alias("d")).count()
    top = sizes.agg(F.max(F.struct("count", "d"))).first()[0]
    d = top["d"] if top else 0
    return good.filter(F.size("vec") == d), d


def grid_blocks(good: DataFrame, d: int, rows: int = BLOCK_ROWS) -> DataFrame:
    """Staged blocks (part, k, ids, x): block k of a task holds up to ``rows`` ids and their grid rows (int64)."""
    kind = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("k", T.IntegerType()),
                         T.StructField("ids", T.ArrayType(good.schema["id"].dataType)),
                         T.StructField("x", T.BinaryType())])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema
        schema, part, k = to_arrow_schema(kind), TaskContext.get().partitionId(), 0

        def block(ids, vec):
            x = np.floor(GRID * vec).astype(np.int64) + OFFSET
            lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([k], pa.int32()),
                                               lists.cast(schema.field("ids").type), pa.array([x.tobytes()])], schema=schema)
        ids, vec = None, np.empty((0, d))
        for batch in batches:
            more = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            vec = np.concatenate([vec, more])
            ids = batch.column(0) if ids is None else pa.concat_arrays([ids, batch.column(0)])
            while len(vec) >= rows:
                yield block(ids[:rows], vec[:rows])
                ids, vec, k = ids[rows:], vec[rows:], k + 1
        if len(vec):
            yield block(ids, vec)
    return stage(good.mapInArrow(run, kind), "grid-blocks", compression="zstd")


def _column_sums(blocks: DataFrame, value, width: int, kind: str) -> list:
    """Sums over all blocks of the ``width`` numbers that ``value(x bytes)`` gives for one; added up by Spark."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for x in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(value(x))], names=["at", "v"])
    found = blocks.mapInArrow(run, f"at long, v {kind}").groupBy("at").agg(F.sum("v").alias("v")).collect()
    out = [0] * width
    for r in found:
        out[r["at"]] = r["v"]
    return out


def _rows_of(blocks: DataFrame, offsets: dict[int, int], rows: int, make, kind: T.StructType) -> DataFrame:
    """One row per vector of ``blocks``: ``make(ids, x)`` gives the Arrow columns after the vector's index.

    Only the last block of a task may hold less than ``rows`` vectors.
    """
    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema
        schema = to_arrow_schema(kind)
        for batch in batches:
            for part, k, ids, x in zip(*batch.columns):
                x = np.frombuffer(x.as_py(), np.int64).reshape(len(ids), -1)
                first = offsets[part.as_py()] + k.as_py() * rows
                cols = [pa.array(np.arange(first, first + len(ids))), *make(ids.values, x)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema)], schema=schema)
    return blocks.mapInArrow(run, kind)


def _block_matrix(blocks: DataFrame, offsets, centre: np.ndarray, n: int, rows: int) -> BlockMatrix:
    """The centred rows, indexed, as a block matrix."""
    import pyarrow as pa
    d = len(centre)

    def centred(ids, x):
        at = pa.array(np.arange(0, x.size + 1, d, dtype=np.int32))
        return [pa.ListArray.from_arrays(at, pa.array((x - centre).astype(float).ravel()))]
    kind = T.StructType([T.StructField("index", T.LongType()), T.StructField("y", T.ArrayType(T.DoubleType()))])
    table = _rows_of(blocks, offsets, rows, centred, kind).select("index", array_to_vector("y").alias("vector"))
    table = MLUtils.convertVectorColumnsFromML(table, "vector")
    return IndexedRowMatrix(table, n, d).toBlockMatrix(rows, min(d, BLOCK_COLS))


def _scatter(matrix: BlockMatrix, size: int) -> np.ndarray:
    """Transposed matrix times matrix, the middle dimension in splits of bounded bytes."""
    splits = max(1, -(-size // SPLIT_BYTES))
    product = matrix.transpose()._java_matrix_wrapper.call(
        "multiply", matrix._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def principal(scatter: np.ndarray, sums: list[int], centre: np.ndarray, n: int, most: int):
    """(whitening matrix, its shift, shares of the trace) of up to ``most`` components.

    A component whose variance is nil to double precision has NaN columns.
    """
    rest = np.array([(s - n * int(c)) / n for s, c in zip(sums, centre)])
    cov = scatter / n - np.outer(rest, rest)
    cov = (cov + cov.T) / 2
    value, vector = np.linalg.eigh(cov)
    value, vector = value[::-1][:most], vector[:, ::-1][:, :most]
    trace = float(np.trace(cov))
    nil = value <= max(float(value[0]), 0.0) * len(cov) * np.finfo(float).eps
    with np.errstate(divide="ignore", invalid="ignore"):
        weights = np.where(nil, np.nan, vector / np.sqrt(np.where(nil, 1.0, value)))
    return weights, rest @ weights, (np.where(nil, 0.0, value) / trace if trace > 0 else np.zeros(len(value)))


def _deviations(x: np.ndarray, sums: list[int], n: int) -> list[int]:
    """Sum over dimensions of (n x - S)^2 per row, exact."""
    if n * int(np.abs(x).max(initial=1)) < 1 << 62:
        gap = n * x - np.array(sums, np.int64)
        if int(np.abs(gap).max(initial=0)) ** 2 * len(sums) < 1 << 63:
            return (gap * gap).sum(axis=1).tolist()
    gap = n * x.astype(object) - np.array(sums, object)
    return (gap * gap).sum(axis=1).tolist()


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS,
           rows: int = BLOCK_ROWS) -> DataFrame:
    """id, component (from 1), n, deviation (decimal), whitened, explained, identity_error.

    One row per usable vector (see ``usable``) and component; repeated and
    null ids are vectors like any other. Without a usable vector the result
    is empty. A component without variance has whitened NULL and explained 0,
    and takes no part in identity_error (NULL if none does). A deviation of
    more than 38 digits is NULL.
    """
    spark = vectors.sparkSession
    good, d = usable(vectors, id_col, vector_col)
    blocks = grid_blocks(good, d, rows)
    parts = {r["part"]: r["n"] for r in blocks.groupBy("part").agg(F.sum(F.size("ids")).alias("n")).collect()}
    n = sum(parts.values())
    id_kind = good.schema["id"].dataType
    if not n:
        return spark.createDataFrame([], T.StructType([
            T.StructField("id", id_kind), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
            T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("whitened", T.DoubleType()),
            T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType())]))
    offsets, at = {}, 0
    for p in sorted(parts):
        offsets[p], at = at, at + parts[p]

    sums = [int(s) for s in _column_sums(blocks.select("x"), lambda x: np.frombuffer(x, np.int64).reshape(-1, d).sum(axis=0),
                                         d, "decimal(38,0)" if n > 1 << 30 else "long")]
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    matrix = _block_matrix(blocks, offsets, centre, n, rows)
    weights, shift, explained = principal(_scatter(matrix, n * d * 8), sums, centre, n, components)
    k, flat = weights.shape[1], np.nan_to_num(weights)

    steps = [((j // BLOCK_COLS, 0), DenseMatrix(len(flat[j:j + BLOCK_COLS]), k, flat[j:j + BLOCK_COLS].ravel("F")))
             for j in range(0, d, BLOCK_COLS)]
    projected = matrix.multiply(BlockMatrix(spark.sparkContext.parallelize(steps, 1), matrix.colsPerBlock, k, d, k))
    # Rows stay in the JVM: index and vector as a table, not as Python objects.
    z = callMLlibFunc("getIndexedRows", projected.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    less = F.array(*[F.lit(float(v)) for v in np.nan_to_num(shift)])
    z = z.select("index", F.zip_with(vector_to_array("vector"), less, lambda a, b: a - b).alias("z"))

    def described(ids, x):
        import pyarrow as pa
        return [ids, pa.array([v if v < 10 ** 38 else None for v in _deviations(x, sums, n)], pa.decimal128(38, 0))]
    about = _rows_of(blocks, offsets, rows, described, T.StructType([
        T.StructField("index", T.LongType()), T.StructField("id", id_kind), T.StructField("deviation", T.DecimalType(38, 0))]))
    joined = stage(about.join(z, "index").select("id", "deviation", "z"), "whitened")

    real = np.flatnonzero(~np.isnan(weights).any(axis=0))
    m = len(real)

    def moments(batches):
        import pyarrow as pa
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(-1, k)[:, real]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(m + m * m)), pa.array(np.r_[x.sum(axis=0), (x.T @ x).ravel()])],
                                             names=["at", "v"])
    total = np.zeros(m + m * m)
    for r in joined.select("z").mapInArrow(moments, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        total[r["at"]] = r["v"] / n
    error = total[m:].reshape(m, m) - np.outer(total[:m], total[:m]) - np.eye(m)
    error = float(np.abs(error).max()) if m else None
    # Literal per component: its number, share, and whether it has a variance at all.
    there = F.array(*[F.lit(bool(j in real)) for j in range(k)])
    shares = F.array(*[F.lit(float(v)) for v in explained])
    return joined.select("id", "deviation", F.posexplode("z").alias("at", "z")).select(
        "id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        F.when(F.get(there, F.col("at")), F.col("z")).alias("whitened"), F.get(shares, F.col("at")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"))


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    found = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select(F.col("id").alias("vec_id"), "component", "n", F.expr("try_cast(deviation as bigint)").alias("deviation"),
                        "whitened", "explained", "identity_error")
