"""Reading inputs and cutting lineage, shared by the operators of this package."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: One Arrow batch of whole texts is worked on in pieces of about so many bytes.
PIECE_BYTES = 4 << 20
_own: dict[str, str] = {}
_SPACE = re.compile(rb"[ \t\n\x0b\x0c\r]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it. Where none is named: a folder of our own, if there is but one machine, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = _own.setdefault("dir", f"file://{tempfile.mkdtemp(prefix='haploweave-')}")
    return f"{base.rstrip('/')}/haploweave-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lost executors then cost only their own tasks."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)  # when the application ends
    return spark.read.schema(df.schema).parquet(path)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folded(text):
    """The bytes of a text with A-Z in lower case; of one that isn't UTF-8 too."""
    by_byte = F.encode(F.translate(F.decode(text.cast("binary"), "ISO-8859-1"), _UPPER, _LOWER), "ISO-8859-1")
    return F.when(F.is_valid_utf8(text), F.translate(text, _UPPER, _LOWER).cast("binary")).otherwise(by_byte)


def pieces(batches, text: str = "text", size: int = PIECE_BYTES):
    """Arrow batches cut so that the texts of each hold about ``size`` bytes, or one longer text."""
    for batch in batches:
        sizes = batch.column(text).cast(pa.large_binary()) if batch.num_rows else None
        start, held = 0, 0
        for i in range(batch.num_rows):
            n = len(sizes[i].as_buffer()) if sizes[i].is_valid else 0
            if i > start and held + n > size:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if batch.num_rows > start:
            yield batch.slice(start)
    release()


def release() -> None:
    """Give the memory that a task has freed back to the system: a worker stays for the tasks that follow, beside the executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries have it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def trimmed(function):
    """A function over batches that gives back what it has freed when its task ends."""

    def run(batches):
        yield from function(batches)
        release()

    return run


#: Bytes of a batch of rows that goes to Python at most, and rows that Spark reads from Parquet at once, where the session doesn't say.
BATCH_BYTES, READ_ROWS = 4 << 20, 512


def small_batches(spark: SparkSession) -> None:
    """From now on the session's batches of rows for Python hold BATCH_BYTES at most, and READ_ROWS are read at once, unless it has limits of its own: whole texts are long, and a batch is held on both sides."""
    for name, usual, ours in (("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", f"{BATCH_BYTES}b"), ("spark.sql.parquet.columnarReaderBatchSize", "4096", str(READ_ROWS))):
        if spark.conf.get(name) == usual:  # the default; with a default given here, one that isn't set would be that, not Spark's
            spark.conf.set(name, ours)


def small_table(spark: SparkSession, rows: list[tuple], schema: pa.Schema) -> DataFrame:
    """A few rows as a table, by Arrow: rows of Python objects would start a second set of Python workers, which stay beside the executors."""
    held = pa.Table.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows] or [{}], schema)
    return spark.createDataFrame(held).where(F.lit(bool(rows)))


def as_bytes(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def text_column(texts: list[bytes | None]) -> pa.Array:
    """A column of strings, as they are: not checked to be UTF-8."""
    return pa.array(texts, pa.binary()).view(pa.string())


class Filter:
    """A Bloom filter of fixed size over 64-bit hashes, with four positions for each."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
        a, b = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
        return (a + b * np.arange(1, 5, dtype=np.uint64)[:, None]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)

    @classmethod
    def over(cls, hashes: np.ndarray, bits: int) -> Filter:
        """Of 1 << ``bits`` bits."""
        words = np.zeros(1 << (bits - 6), np.uint64)
        at = cls._places(hashes, bits).ravel()
        np.bitwise_or.at(words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        return cls(words)

    @classmethod
    def gather(cls, rows: DataFrame, hashes, bits: int = 27) -> Filter:
        """Over what ``hashes(batches)`` yields, arrays of hashes: of 1 << ``bits`` bits at most, and as small as what it holds allows."""

        def mark(batches):
            for found in hashes(batches):
                at = np.unique(cls._places(found, bits))
                word, first = np.unique(at >> np.uint64(6), return_index=True)
                if len(word):
                    mask = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first)
                    yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(mask.view(np.int64))], names=["word", "mask"])

        words = np.zeros(1 << (bits - 6), np.uint64)
        for batch in rows.mapInArrow(mark, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow().to_batches():
            words[batch.column(0).to_numpy()] = batch.column(1).to_numpy().view(np.uint64)
        return cls(words).folded()

    def folded(self) -> Filter:
        """The same filter with fewer bits, where few are set: a place's upper bits are its place in a smaller one."""
        bits, some = len(self.words).bit_length() + 5, np.flatnonzero(self.words)
        word, bit = np.nonzero(np.unpackbits(self.words[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        fewer = min(bits, max(10, (5 * len(word)).bit_length()))
        at = (some[word] * 64 + bit) >> (bits - fewer)
        words = np.zeros(1 << (fewer - 6), np.uint64)
        np.bitwise_or.at(words, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        return Filter(words)

    def hold(self, hashes: np.ndarray) -> np.ndarray:
        """Which of the hashes it may hold; those it was made of, it does."""
        at = self._places(hashes, len(self.words).bit_length() + 5)
        return ((self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).all(0)

    def has(self, hash: int) -> bool:
        return bool(self.hold(np.array([hash], np.uint64))[0])


def _identifiers(batches):
    for batch in batches:
        yield mixed(batch.column(0).drop_null().to_numpy(zero_copy_only=False).view(np.uint64))


def mixed(x: np.ndarray) -> np.ndarray:
    """Numbers (unsigned, 64 bits) one-to-one to hashes."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def may_be_among(column, ids: DataFrame):
    """A condition: whether the value of ``column``, a long, may be among ``ids``, a table of one long column. Never false for one that is.

    A filter of at most 8 MB is sent to the tasks, however many ids there are; the
    more there are, the more values pass. Only ``column`` goes through Python.
    Rows that can't be among ids thus need not be dealt out to look for them.
    """
    shared = ids.sparkSession.sparkContext.broadcast(Filter.gather(ids, _identifiers, bits=26))

    def probe(values: pa.Array) -> pa.Array:
        return pa.array(shared.value.hold(mixed(values.to_numpy(zero_copy_only=False).view(np.uint64))))

    # Spark takes the kind of function from its annotations, which this module's are not when it runs
    probe.__annotations__ = {"values": pa.Array, "return": pa.Array}
    return F.arrow_udf(probe, "boolean")(F.coalesce(column, F.lit(0).cast("long")))


def chunks(text: bytes, size: int = 1 << 20):
    """(offset, slice) of about ``size`` bytes that end with ASCII white space, or at the end."""
    at = 0
    while at < len(text):
        stop = at + size
        if stop < len(text):
            found = _SPACE.search(text, stop)
            stop = found.end() if found else len(text)
        yield at, text[at:stop]
        at = stop


def text_key(text):
    """Two 64-bit hashes of a text (null counts as empty). With the identifier they tell rows apart that share an identifier, not repeated rows."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def unused(columns: list[str], name: str) -> str:
    """``name``, lengthened until no column has it."""
    while name.lower() in {c.lower() for c in columns}:
        name = f"_{name}"
    return name
