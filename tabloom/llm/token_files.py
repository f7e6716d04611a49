"""Token-id output: Parquet lists with dictionary-coded ids and delta-coded metadata.

Documents are ordered by id first (the text moves once, the larger ids never
do), tokenized where they then are, and written by Spark's Parquet writer:
``tokens`` is a dictionary-coded list column, the integer columns are
delta-coded (format version 2), and row groups and pages are bounded, so that
the page index lets a reader fetch metadata alone or the tokens of a few ids.

``part`` and ``offset`` (ids before the document in its part) make the place
of a document in the whole stream a sum of two numbers.
"""

from __future__ import annotations

import re
import zlib

import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.shared import bounded, shared_folder, text_slices

ROW_GROUP_BYTES = 32 << 20
PAGE_ROWS = 2000
FILE_ROWS = 1_000_000
CACHE_WORDS = 100_000     # entries of each generation of the two caches, which a Python worker keeps between tasks
SLICE_BYTES = 4 << 20     # text encoded at once
SCHEMA = "doc_id long, part int, offset long, n_tokens long, tokens array<int>"

# How the tokenizer file splits lower-cased words, and its byte alphabet: printable Latin-1 stands for
# itself, the other bytes follow from U+0100 on.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
# Latin letters: composed already, and lower case does not depend on their neighbours.
_LATIN = re.compile("[\x00-\u012f\u0131-\u023f]*")
# A word of such letters, all of them, with signs after it.
_PLAIN = "^(?P<body>[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+)(?P<tail>[.,]*)$"
_ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_CHARS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}


class _Cache:
    """Two generations of a dictionary: when the newer is full it becomes the older, whose hits move up."""

    def __init__(self, make):
        self.make, self.new, self.old = make, {}, {}

    def missing(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self.new) >= CACHE_WORDS:
            self.old, self.new = self.new, {}
        self.new[key] = value
        return value

    def all(self, keys: list) -> list:
        found = []
        for lo in range(0, len(keys), 10_000):
            part = keys[lo:lo + 10_000]
            values = list(map(self.new.get, part))
            if None in values:
                values = [v if v is not None else self.missing(k) for v, k in zip(values, part)]
            found += values
        return found


class WordEncoder:
    """Ids of a text as little-endian uint32 bytes, word by word with bounded caches.

    For a tokenizer whose normalizer and pre-tokenizer drop white space and
    never look across it (``word_bpe_49k.json``), the ids of a text are those
    of its white-space-separated words in turn; each word is encoded once.
    Plain Latin words are split here, all others by the tokenizer's own
    normalizer and pre-tokenizer; the merges are always the library's. Of a
    word of letters and signs after it only these pieces are kept.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model
        self.ids = [k.to_bytes(4, "little") for k in range(self.tokenizer.get_vocab_size())]
        self.words, self.pieces = _Cache(self._word), _Cache(self._piece)

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece; one that the library cut, in its byte alphabet already, has a space before it."""
        if piece[:1] == " ":
            piece = piece[1:]
        elif not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(_BYTE_CHARS)
        return b"".join([self.ids[t.id] for t in self.merges.tokenize(piece)])

    def _word(self, word: bytes) -> bytes:
        get, cache = self.pieces.new.get, self.pieces
        body = word.rstrip(b".,")
        if body.isalpha():              # ASCII letters, then signs
            first = body.lower().decode()
            ids = get(first) or cache.missing(first)
            if len(body) == len(word):
                return ids
            tail = word[len(body):].decode()
            return ids + (cache.new.get(tail) or cache.missing(tail))
        text = word.decode(errors="replace")
        plain = text.isascii()
        latin = plain or _LATIN.fullmatch(text) is not None
        body = text.rstrip(".,")
        if latin and body.isalpha():    # one run of letters, one of signs
            pieces = [body.lower(), text[len(body):]] if len(body) < len(text) else [body.lower()]
        elif "<|" in text:              # may hold an added token
            return b"".join([self.ids[i] for i in self.tokenizer.encode(text, add_special_tokens=False).ids])
        elif latin and text.isprintable():
            pieces = (_ASCII_PIECES if plain else _PIECES).findall(text.lower())
        else:
            pieces = [" " + p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(
                self.tokenizer.normalizer.normalize_str(text))]
        return b"".join([get(p) or cache.missing(p) for p in pieces])

    def encode(self, text: bytes | None) -> bytes:
        return b"".join(self.words.all((text or b"").split()))

    def encode_all(self, texts, end_id: int):
        """(ids of all texts, each with ``end_id`` after it; number of ids of each) of a binary Arrow array.

        Each different word of the array is looked up once, however often it comes.
        """
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        texts = pc.fill_null(texts.cast(pa.binary()), b"")
        words = pc.ascii_split_whitespace(_as(texts, pa.string()))
        coded = words.values.dictionary_encode()
        taken = self._lists(coded.dictionary).take(coded.indices)
        at = taken.offsets.to_numpy()[words.offsets.to_numpy()]
        return np.insert(taken.values.to_numpy(), at[1:], end_id), np.diff(at).astype(np.int64) + 1

    def _lists(self, words):
        """Ids of different words, a list each: a run of letters and one of signs by their pieces, others by ``_word``."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        parts = pc.extract_regex(words, _PLAIN)
        is_plain = parts.is_valid()
        parts, others = parts.filter(is_plain), words.filter(pc.invert(is_plain))
        bodies = pc.utf8_lower(parts.field("body")).dictionary_encode()
        tails = parts.field("tail").dictionary_encode()
        ids = _id_lists(self.pieces.all(_objects(bodies.dictionary)) + self.pieces.all(_objects(tails.dictionary)))
        both = np.stack([bodies.indices.to_numpy(), tails.indices.to_numpy() + len(bodies.dictionary)], axis=1)
        ids = ids.take(pa.array(both.reshape(-1)))
        plain = pa.ListArray.from_arrays(pa.array(ids.offsets.to_numpy()[::2]), ids.values)
        place = np.empty(len(words), np.int32)
        place[np.argsort(~is_plain.to_numpy(zero_copy_only=False), kind="stable")] = np.arange(len(words))
        rest = _id_lists(self.words.all(_objects(_as(others, pa.binary()))))
        return pa.concat_arrays([plain, rest]).take(pa.array(place))


def _objects(array) -> list:
    return array.to_numpy(zero_copy_only=False).tolist()


def _id_lists(found: list[bytes]):
    """Arrow lists of the ids in ``found``."""
    import numpy as np
    import pyarrow as pa
    at = np.cumsum([0, *map(len, found)]) // 4
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(np.frombuffer(b"".join(found), np.int32)))


def _as(array, kind):
    """A binary or string Arrow array as the other of the two, bytes unchecked."""
    import pyarrow as pa
    return pa.Array.from_buffers(kind, len(array), array.buffers(), offset=array.offset)


class TextEncoder:
    """Ids of whole texts by the library's own encode; for any tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)

    def encode(self, text: bytes | None) -> bytes:
        ids = self.tokenizer.encode((text or b"").decode(errors="replace"), add_special_tokens=False).ids
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def encode_all(self, texts, end_id: int):
        """As ``WordEncoder.encode_all``."""
        import numpy as np
        end = end_id.to_bytes(4, "little")
        ids = [self.encode(t) + end for t in texts.to_pylist()]
        return np.frombuffer(b"".join(ids), np.int32), np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))


_encoders: dict = {}


def write_token_files(docs: DataFrame, tokenizer: str, path: str | None = None, id_col: str = "doc_id",
                      text_col: str = "text", end_id: int = 2, by_word: bool = False) -> str:
    """Write the ids of every document, in ascending id order, and return the folder.

    ``end_id`` is appended to each document; a null text is empty; rows
    without an id come first, in no defined order; rows repeated with an id
    stand together. ``by_word`` uses ``WordEncoder`` (see there).
    """
    path = path or shared_folder(docs.sparkSession, "tokens")

    def encode(batches):
        import numpy as np
        import pyarrow as pa
        key = (tokenizer, by_word)
        if key not in _encoders:
            _encoders[key] = (WordEncoder if by_word else TextEncoder)(tokenizer)
        encoder, part, offset = _encoders[key], TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo, n in text_slices(batch.column(1), SLICE_BYTES):
                ids, sizes = encoder.encode_all(batch.column(1).slice(lo, n), end_id)
                ends = np.cumsum(sizes)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, n), pa.array(np.full(n, part, np.int32)),
                     pa.array(offset + ends - sizes), pa.array(sizes), lists],
                    names=["doc_id", "part", "offset", "n_tokens", "tokens"])
                offset += int(ends[-1])
            pa.default_memory_pool().release_unused()

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    # Rows without an id are spread by arrival, not gathered in one range.
    spread = F.when(F.col("id").isNull(), F.monotonically_increasing_id())
    ordered = src.repartitionByRange("id", spread).sortWithinPartitions("id")
    (ordered.mapInArrow(encode, SCHEMA).write.option("compression", "zstd")
     .option("parquet.writer.version", "PARQUET_2_0").option("parquet.block.size", ROW_GROUP_BYTES)
     .option("parquet.page.row.count.limit", PAGE_ROWS).option("parquet.enable.dictionary", "false")
     .option("parquet.enable.dictionary#tokens.list.element", "true")
     .option("maxRecordsPerFile", FILE_ROWS).parquet(path))
    return path


def read_tokens(spark: SparkSession, path: str, ids: list[int] | None = None) -> DataFrame:
    """doc_id and tokens; ``ids`` prunes row groups and pages by the doc_id index."""
    df = spark.read.schema(SCHEMA).parquet(path).select("doc_id", "tokens")
    return df if ids is None else df.filter(F.col("doc_id").isin(ids))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens; reads no token page."""
    files = spark.read.schema(SCHEMA).parquet(path)
    return _placed(files.select("doc_id", "part", "offset", "n_tokens"), files).select(
        "doc_id", "start", "n_tokens")


def _placed(rows: DataFrame, files: DataFrame) -> DataFrame:
    """``rows`` with start = ids of all earlier parts + offset in its part.

    One total per written part (that is per task) is summed up; the parts
    number as many as the tasks of the write.
    """
    from pyspark.sql import Window
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    n = files.agg(F.max("part")).first()[0] or 0
    return rows.join(bounded(base, n + 1, 16), "part").withColumn("start", F.col("base") + F.col("offset"))


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from the files."""
    files = spark.read.schema(SCHEMA).parquet(path)

    def digest(batches):
        import numpy as np
        import pyarrow as pa
        for b in batches:
            lists = b.column(3)
            data = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            at = lists.offsets.to_numpy()
            crc = [zlib.crc32(memoryview(np.ascontiguousarray(data[x:y]))) for x, y in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(np.diff(at).astype(np.int64)),
                 pa.array(crc, pa.int64())], names=["doc_id", "part", "offset", "n_tokens", "ids_crc32"])

    read = files.select("doc_id", "part", "offset", "tokens").mapInArrow(
        digest, "doc_id long, part int, offset long, n_tokens long, ids_crc32 long")
    return _placed(read, files).select("doc_id", "start", "n_tokens", "ids_crc32")


def word_bpe_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op2_token_files(spark, sf_dir: str) -> DataFrame:
    path = write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), word_bpe_path(), by_word=True)
    return token_digests(spark, path)
