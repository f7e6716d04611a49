"""Records of CSV files with quoted newlines, read by many tasks per file.

The files are scanned as lines, split among tasks as usual. Whether a line
starts inside a quoted field depends on all lines before it, so the work is
done in two passes over the splits. The first finds, for a split, the state at
its end for either state at its start; putting these together in file order
gives the state at the start of every split. The second joins the lines of a
split to records from there. A record that is open at the end of a split is
completed by the lines that head the next ones: such pieces, two a split at
most, meet by the split that the record began in.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A line that starts outside a quoted field: whole fields, then maybe an open one. A quote opens a field
# only at its start; what follows a closing quote up to the delimiter belongs to the field.
_FIELD = r'(?:"(?:[^"]|"")*"(?!")[^,]*|[^",][^,]*|)'
_WHOLE = re.compile(rf"{_FIELD}(?:,{_FIELD})*\Z", re.S)
_CLOSE = re.compile(r'(?:[^"]|"")*"(?!")[^,]*(?:\Z|(,))', re.S)


def open_after(line: str, inside: bool) -> bool:
    """Whether a quoted field is open at the end of ``line``, which starts in one or not."""
    if '"' not in line:
        return inside
    if inside:
        m = _CLOSE.match(line)
        if m is None:
            return True
        if m[1] is None:
            return False
        line = line[m.end():]
    return _WHOLE.match(line) is None


def _lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    df = (spark.read.option("pathGlobFilter", "*.[cC][sS][vV]").option("lineSep", "\n").text(path)
          .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at")))
    value = F.col("value") if encoding == "UTF-8" else F.decode(F.col("value").cast("binary"), encoding)
    return df.select(value.alias("value"), "file", "at")


def _rows(batches):
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def split_states(lines: DataFrame) -> dict[tuple[str, int], tuple[bool, int]]:
    """(file, split start) -> (starts inside a quoted field, start of the split in which its open record began).

    One row per split comes to the driver.
    """
    def ends(batches):
        import pyarrow as pa
        out, key, state = [], None, None
        for value, file, at in _rows(batches):
            if (file, at) != key:
                if key:
                    out.append((*key, *state))
                key, state = (file, at), (False, True)
            if '"' in value:
                state = tuple(open_after(value, s) for s in state)
        if key:
            out.append((*key, *state))
        yield pa.RecordBatch.from_pylist([dict(zip(("file", "at", "after_out", "after_in"), r)) for r in out], schema=pa.schema(
            [("file", pa.string()), ("at", pa.int64()), ("after_out", pa.bool_()), ("after_in", pa.bool_())]))
    found = lines.mapInArrow(ends, "file string, at long, after_out boolean, after_in boolean").collect()
    quiet = {(r["file"], r["at"]) for r in lines.where("instr(value, '\"') > 0").select("file", "at").distinct().collect()}
    out, file, inside, began = {}, None, False, 0
    for r in sorted(found, key=lambda r: (r["file"], r["at"])):
        if r["file"] != file:
            file, inside, began = r["file"], False, r["at"]
        out[file, r["at"]] = (inside, began)
        closes = (file, r["at"]) in quiet       # a split without a quote hands its state on
        inside = r["after_in"] if inside else r["after_out"]
        began = r["at"] if closes or not inside else began
    return out


def read_records(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """(file, header, record): every record of the files as text, newlines in quoted fields kept.

    ``header`` marks the first record of each file. Empty lines between
    records are skipped; an unclosed field at the end of a file ends there.
    """
    lines = _lines(spark, path, encoding)
    states = spark.sparkContext.broadcast(split_states(lines))

    def join(batches):
        import pyarrow as pa
        names = ["file", "at", "chain", "first", "whole", "record"]
        schema = pa.schema([("file", pa.string()), ("at", pa.int64()), ("chain", pa.int64()), ("first", pa.bool_()),
                            ("whole", pa.bool_()), ("record", pa.string())])
        out, key, held, inside, head, first = [], None, [], False, False, False

        def done(whole):
            """Give out the held lines: a record, or a piece of one that began in split ``chain``."""
            nonlocal first
            text = "\n".join(held)
            if whole and not head:
                text = text.removesuffix("\r")
                if text:
                    out.append((*key, key[1], first, True, text))
                    first = False
            elif held:
                out.append((*key, states.value[key][1] if head else key[1], first, False, text))
            held.clear()
        for value, file, at in _rows(batches):
            if (file, at) != key:
                if key:
                    done(False)
                key = (file, at)
                inside = head = states.value[key][0]
                first = at == 0
            held.append(value)
            inside = open_after(value, inside)
            if not inside:
                done(True)
                head = False
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, schema.field(n).type) for c, n in zip(zip(*out), names)], schema=schema)
                out = []
        if key:
            done(False)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, schema.field(n).type) for c, n in zip(zip(*out), names)], schema=schema)
    parts = lines.mapInArrow(join, "file string, at long, chain long, first boolean, whole boolean, record string")
    whole = parts.where("whole").select("file", F.col("first").alias("header"), "record")
    joined = (parts.where("NOT whole").groupBy("file", "chain")
              .agg(F.max("first").alias("header"), F.array_sort(F.collect_list(F.struct("at", "record"))).alias("p"))
              .select("file", "header", F.regexp_replace(F.array_join(F.transform("p", lambda x: x["record"]), "\n"), r"\r\z", "")
                      .alias("record")))
    return whole.unionByName(joined.where("record <> ''"))
