"""What the corpus operators share: staging tables, Arrow settings, word rules."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that end a word in the corpus contracts: space and U+0009 to U+000D.
SPACE = "\\x20\\x09-\\x0D"
#: One pattern for a word, in the regular-expression syntax Java and DuckDB share.
WORD = f"[^{SPACE}]+"
#: Rows of one Arrow batch: texts are long, and a batch is held by both sides.
BATCH_ROWS = 500


def session_of(df: DataFrame) -> SparkSession:
    """The session of a frame, with Arrow batches that suit long texts."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def in_turn(*steps):
    """Functions on batches, one after another in one Python worker.

    Each of several mapInArrow in a row keeps a worker of its own for every
    task, and its memory with it.
    """

    def run(batches: Iterator) -> Iterator:
        for step in steps:
            batches = step(batches)
        return batches

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or, on one machine only, a folder of its own."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/siftstone-checkpoints"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Cuts lineage like checkpoint(), but keeps column pruning and compression;
    the files survive the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/siftstone/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def new_names(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that a frame doesn't have, in any case."""
    held = {c.lower() for c in df.columns}
    return [next(x for x in (f"{name}{'_' * k}" for k in range(len(held) + 1)) if x.lower() not in held) for name in names]


def clean_text(col: str | Column = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def id_crc32(col: str | Column = "doc_id") -> Column:
    """crc32 of the id as decimal text; a null id counts as the empty text."""
    text = (F.col(col) if isinstance(col, str) else col).cast("string")
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def byte_texts(column: pa.Array) -> list[bytes]:
    """Texts of an Arrow string column as UTF-8 bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


def word_codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Words of an Arrow string column, A-Z lower-cased, as (code of each word, words of each text, word of each code); null is empty."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(column.fill_null("")))
    flat = lists.flatten()
    coded = flat.dictionary_encode()
    codes, names = coded.indices.to_numpy(), coded.dictionary.cast(pa.binary() if pa.types.is_string(flat.type) else pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
    sizes = np.diff(lists.offsets.to_numpy())
    if b"" in names:  # white space at the ends of a text splits off an empty word
        real = codes != names.index(b"")
        text = np.repeat(np.arange(len(sizes)), sizes)
        codes, sizes = codes[real], np.bincount(text[real], minlength=len(sizes))
    return codes, sizes, names


def crc32_of(values: Iterable) -> list[int]:
    """id_crc32 on the Python side."""
    return [zlib.crc32(b"" if x is None else str(x).encode()) for x in values]


class Memo(dict):
    """A bounded dict that makes missing values with a function.

    When half of what it may hold is new, the older half is forgotten, unless it
    has been asked for meanwhile; so memory is bounded whatever the vocabulary,
    frequent keys stay, and results never depend on it.
    """

    def __init__(self, make, most: int = 400_000):
        super().__init__()
        self._make, self._half, self._older = make, most // 2, {}

    def __missing__(self, key):
        value = self._older.pop(key, _ABSENT)
        if value is _ABSENT:
            value = self._make(key)
        if len(self) >= self._half:
            self._older = dict(self)
            self.clear()
        self[key] = value
        return value


_ABSENT = object()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of the 64-bit integers (the murmur3 finaliser)."""
    x = x.copy()
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Group tuples into Arrow batches of bounded size."""
    block: list[tuple] = []
    for row in rows:
        block.append(row)
        if len(block) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*block), schema, strict=True)], schema=schema)
            block = []
    if block:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*block), schema, strict=True)], schema=schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
