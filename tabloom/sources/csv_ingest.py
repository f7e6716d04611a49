"""CSV ingest: source gate, encoding choice, NA tokens, type inference,
quarantine of over-long rows, landing write and registration.

The scan is Spark's CSV reader with every column read as text; types are
then inferred from the data in one aggregate pass (how many non-missing
values look boolean, integral, or numeric per column) and applied as one
projection of ``try_cast``s. Nothing is parsed on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions.columns import col, q
from tabloom.sources.csv_records import read_records

# Fixed values of the reference behaviour (pandas' default missing-value tokens).
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
             "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
BOOLEAN_TOKENS = ["True", "False", "TRUE", "FALSE", "true", "false"]
UPLOAD_LIMIT_BYTES = 500 * 1024 * 1024   # the gate of the reference; off unless passed as max_bytes
CORRUPT = "_corrupt_record"
INTEGER_PATTERN = r"^\s*[+-]?[0-9]+\s*$"
# Java's number parser also takes type suffixes ("12D"); those are text here.
NUMBER_PATTERN = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$|^\s*[+-]?(?i:inf|infinity)\s*$"
CSV_OPTIONS = {"quote": '"', "escape": '"'}      # a doubled quote is a quote


class IngestError(ValueError):
    pass


def check_sources(spark: SparkSession, path: str) -> DataFrame:
    """``(path, length)`` of the ``*.csv`` files; contents are not read."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", "*.[cC][sS][vV]")
            .load(path).select("path", "length"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("pathGlobFilter", "*.[cC][sS][vV]").text(path)


def choose_encoding(spark: SparkSession, path: str, max_bytes: int | None = None) -> str:
    """UTF-8 if every line of every file decodes, else ISO-8859-1 (which takes any byte).

    Files are checked line by line in a distributed scan. ``max_bytes`` (off
    by default) refuses a source with a larger file.
    """
    files = check_sources(spark, path)
    limit = F.lit(max_bytes if max_bytes is not None else (1 << 63) - 1)
    sizes = files.agg(F.count("*").alias("n"),
                      F.min(F.when(F.col("length") > limit, F.col("path"))).alias("big")).first()
    if not sizes["n"]:
        raise IngestError(f"no .csv file under '{path}'")
    if sizes["big"]:
        raise IngestError(f"file larger than {max_bytes} bytes: {sizes['big']}")
    broken = _lines(spark, path).where(~F.is_valid_utf8("value")).limit(1).count()
    return "ISO-8859-1" if broken else "UTF-8"


def has_quoted_newlines(spark: SparkSession, path: str) -> bool:
    """Whether some line holds an odd number of quotes, so that a record spans lines."""
    quotes = F.length("value") - F.length(F.translate("value", '"', ""))
    return _lines(spark, path).where(quotes % 2 == 1).limit(1).count() > 0


def read_text_table(spark: SparkSession, path: str, encoding: str) -> tuple[DataFrame, list[str]]:
    """All-string scan with a corrupt-record column; NA tokens become NULL.

    Files are split among tasks, also where quoted fields hold newlines: their
    records are put together first (csv_records.py) and parsed one by one.
    """
    options = {**CSV_OPTIONS, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "nullValue": "\u0000",
               "emptyValue": ""}
    if has_quoted_newlines(spark, path):
        records = read_records(spark, path, encoding)
        first = records.where("header").agg(F.min_by("record", "file")).first()[0]
        names = spark.read.option("header", True).option("multiLine", True).options(**CSV_OPTIONS).csv(
            spark.sparkContext.parallelize([first or ""], 1))
        header = names.columns
        schema = ", ".join(f"{q(c)} STRING" for c in header) + f", `{CORRUPT}` STRING"
        # A carriage return or newline inside a field is part of it.
        raw = records.where("NOT header").select(
            F.from_csv("record", schema, {**options, "multiLine": "true"}).alias("r")).select("r.*")
    else:
        reader = lambda: (spark.read.option("header", True).option("encoding", encoding)
                          .options(**CSV_OPTIONS))
        header = reader().option("inferSchema", False).csv(path).columns
        schema = ", ".join(f"{q(c)} STRING" for c in header) + f", `{CORRUPT}` STRING"
        raw = reader().options(**options).schema(schema).csv(path)
    na = F.array(*[F.lit(t) for t in NA_TOKENS])
    clean = raw.select(*[F.when(F.array_contains(na, col(c)) | col(c).isNull(), F.lit(None))
                         .otherwise(col(c)).alias(c) for c in header], col(CORRUPT))
    return clean, header


END_MARK = "\u001f"


def too_many_fields(n: int):
    """Whether the corrupt record, read by the CSV parser, has more than ``n`` fields.

    A mark is appended as one more field: it stands within the first n + 1
    fields exactly if the record has n or fewer (an empty field counts).
    """
    schema = ", ".join(f"f{i} STRING" for i in range(n + 1))
    line = F.concat(F.regexp_replace(CORRUPT, r"[\r\n]+$", ""), F.lit(f",{END_MARK}"))
    fields = F.from_csv(line, schema, {**CSV_OPTIONS, "mode": "PERMISSIVE"})
    within = F.coalesce(F.array_contains(F.array(*[fields[f"f{i}"] for i in range(n + 1)]), END_MARK), F.lit(False))
    return F.col(CORRUPT).isNotNull() & ~within


def infer_types(text: DataFrame, columns: list[str] | None = None) -> dict[str, str]:
    """Spark type per text column: boolean → bigint → double → string.

    A column whose non-missing values are all boolean words is boolean; all
    integral → bigint (double if a value does not fit); all numeric → double;
    otherwise string. An all-missing column is double (pandas reads it as
    float). One aggregate pass over the table.
    """
    columns = columns or text.columns
    aggs = []
    for i, c in enumerate(columns):
        v = col(c)
        aggs += [F.count(v).alias(f"n{i}"),
                 F.count_if(v.isin(*BOOLEAN_TOKENS)).alias(f"b{i}"),
                 F.count_if(v.rlike(INTEGER_PATTERN) & F.trim(v).try_cast("bigint").isNotNull())
                 .alias(f"l{i}"),
                 F.count_if(v.rlike(INTEGER_PATTERN)).alias(f"li{i}"),
                 F.count_if(v.rlike(NUMBER_PATTERN)).alias(f"d{i}")]
    r = text.agg(*aggs).first()
    out = {}
    for i, c in enumerate(columns):
        n = r[f"n{i}"]
        if n == 0:
            out[c] = "double"
        elif r[f"b{i}"] == n:
            out[c] = "boolean"
        elif r[f"l{i}"] == n:
            out[c] = "bigint"
        elif r[f"li{i}"] == n or r[f"d{i}"] == n:
            out[c] = "double"
        else:
            out[c] = "string"
    return out


def apply_types(text: DataFrame, types: dict[str, str]) -> DataFrame:
    def conv(c, t):
        v = col(c)
        if t == "boolean":
            return F.when(v.isNull(), F.lit(None)).otherwise(F.lower(v) == "true").alias(c)
        if t == "string":
            return v.alias(c)
        return F.trim(v).try_cast(t).alias(c)
    return text.select(*[conv(c, types[c]) if c in types else col(c) for c in text.columns])


@dataclass
class Ingested:
    table: DataFrame
    quarantine: DataFrame
    types: dict
    encoding: str
    held: DataFrame

    def release(self) -> None:
        """Drop the cached text once ``table`` and ``quarantine`` are no longer read."""
        self.held.unpersist()


def ingest_csv(spark: SparkSession, path: str, max_bytes: int | None = None) -> Ingested:
    """Gate, scan, quarantine rows with too many fields, infer and cast.

    Raises :class:`IngestError` for a missing / oversized / non-CSV source
    or when no data row remains. The owner calls ``release()``.
    """
    enc = choose_encoding(spark, path, max_bytes)
    text, header = read_text_table(spark, path, enc)
    text = text.persist()        # Spark refuses a query on the corrupt column alone
    too_long = F.coalesce(too_many_fields(len(header)), F.lit(False))
    quarantine = text.where(too_long).select(F.col(CORRUPT).alias("raw_line"))
    good = text.where(~too_long).drop(CORRUPT)
    if good.limit(1).count() == 0:
        text.unpersist()
        raise IngestError(f"'{path}' has no data rows")
    types = infer_types(good, header)
    return Ingested(apply_types(good, types), quarantine, types, enc, text)


def dataset_name(path: str) -> tuple[str, str]:
    """(stem, lower-case suffix) of a file path: the name a dataset is registered under."""
    base = path.rstrip("/").rsplit("/", 1)[-1]
    stem, dot, suffix = base.rpartition(".")
    return (stem, f".{suffix.lower()}") if dot and stem else (base, "")


def land(df: DataFrame, root: str, dataset_id: str) -> str:
    """Write the parsed table under a unique name; never overwrite."""
    target = f"{root.rstrip('/')}/{dataset_id}"
    df.write.mode("errorifexists").parquet(target)
    return target


def stringify(df: DataFrame) -> DataFrame:
    """The text a CSV export of ``df`` would hold (NULL stays NULL)."""
    return df.select(*[col(c).cast("string").alias(c) for c in df.columns])
