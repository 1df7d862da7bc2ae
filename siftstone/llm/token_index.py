"""Token ids in raw binary shards, with a minimal perfect hash index for keyed access.

One shard holds a range of document keys in ascending order and is two files:

* ``<shard>.ids``: nothing but token ids, little-endian, 16 bits each where the
  vocabulary fits and 32 bits otherwise.
* ``<shard>.idx``: a JSON header of fixed length, then arrays: the keys in
  order, the id count before each record, the displacement of each bucket, and
  for each slot of the hash the fingerprint and the record it stands for.

``manifest`` rows name the shards with their key ranges and the ids before them.
"""

from __future__ import annotations

import json
import os
import uuid
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftstone.llm.common import Memo, clean_text, documents, mix64, session_of, shared_dir, staged
from siftstone.llm.pretokens import have_lone_spaces, head_and_tail

#: Documents of one shard.
SHARD_ROWS = 16_384
#: Keys for each displacement of the hash, on average.
BUCKET = 4
#: Displacements that are tried together.
TRIES = 64
HEADER = 4096
#: Bytes of text that are encoded together.
GATHER = 4 << 20
_NULL_KEY = np.iinfo(np.int64).min
_MANIFEST = "shard int, path string, low long, high long, nulls long, n_docs long, n_ids long"


def _hashes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each key: the hash that picks its bucket, the one that is displaced, and a 32-bit fingerprint."""
    u = keys.astype(np.int64).view(np.uint64)
    a = mix64(u ^ np.uint64(0x243F6A8885A308D3))
    b = mix64(u + np.uint64(0x13198A2E03707344))
    return a, b, (mix64(a ^ b) >> np.uint64(32)).astype(np.uint32)


def _place(h: np.ndarray, d: int | np.ndarray, n: int) -> np.ndarray:
    return (mix64(h + np.atleast_1d(np.asarray(d, np.uint64)) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(n)).astype(np.int64)


def build_hash(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A minimal perfect hash of distinct keys: (displacement of each bucket, slot of each key).

    Buckets are placed from the largest; a bucket gets the first displacement
    that sends its keys to free slots. A bucket of one key names a free slot
    outright, as the negative number -1 - slot, so the last ones cost nothing.
    """
    n = len(keys)
    if not n:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    a, b, _ = _hashes(keys)
    m = -(-n // BUCKET)
    bucket = (a % np.uint64(m)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    ends = np.cumsum(np.bincount(bucket, minlength=m))
    sizes = np.diff(ends, prepend=0)
    displaced, slots, free = np.zeros(m, np.int32), np.empty(n, np.int64), np.ones(n, bool)
    singles = []
    for k in np.argsort(-sizes, kind="stable"):
        own = order[ends[k] - sizes[k] : ends[k]]
        if len(own) <= 1:
            singles.extend((int(k), int(i)) for i in own)
            continue
        d = 1 - TRIES
        found = np.zeros(0, np.int64)
        while not len(found):
            d += TRIES
            tried = _place(b[own][:, None], np.arange(d, d + TRIES), n)
            ordered = np.sort(tried, axis=0)
            found = np.flatnonzero(free[tried].all(axis=0) & (ordered[1:] != ordered[:-1]).all(axis=0))
        at, d = tried[:, found[0]], d + int(found[0])
        displaced[k], slots[own] = d, at
        free[at] = False
    for (k, i), slot in zip(singles, np.flatnonzero(free)):
        displaced[k], slots[i] = -1 - slot, slot
    return displaced, slots


class Shard:
    """A shard opened for reading: constant-time access by key, and in key order."""

    def __init__(self, base: str):
        self._fs, path = fs.FileSystem.from_uri(base)
        with self._fs.open_input_file(path + ".idx") as f:
            head = json.loads(f.read(HEADER))
            take = lambda kind, n: np.frombuffer(f.read(np.dtype(kind).itemsize * n), kind)
            n, m = head["records"], head["keys"]
            self.keys, self.before = take("<i8", n), take("<i8", n + 1)
            self.displaced, self.prints, self.records = take("<i4", head["buckets"]), take("<u4", m), take("<i4", m)
        self.kind = np.dtype(head["ids"])
        self._ids = self._fs.open_input_file(path + ".ids")

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The first record of each key, or -1 where the stored fingerprint or key says it is absent."""
        if not len(self.prints):
            return np.full(len(keys), -1)
        a, b, prints = _hashes(keys)
        d = self.displaced[(a % np.uint64(len(self.displaced))).astype(np.int64)].astype(np.int64)
        slot = np.where(d < 0, -1 - d, _place(b, np.maximum(d, 0), len(self.prints)))
        record = self.records[slot].astype(np.int64)
        return np.where((self.prints[slot] == prints) & (self.keys[record] == keys), record, -1)

    def ids(self, record: int) -> np.ndarray:
        size = self.kind.itemsize
        return np.frombuffer(self._ids.read_at(int(self.before[record + 1] - self.before[record]) * size, int(self.before[record]) * size), self.kind)

    def records_of(self, keys: list[int | None]) -> list[range]:
        """The records of each key, in one look-up; repeated keys stand side by side."""
        named = np.array([_NULL_KEY if k is None else k for k in keys], np.int64)
        first = self.find(named)
        after = np.searchsorted(self.keys, named, side="right")
        return [range(a, b) if a >= 0 else range(0) for a, b in zip(first.tolist(), after.tolist())]


class Writer:
    """Writes one shard; the files appear whole, under their names, or not at all."""

    def __init__(self, base: str, kind: str):
        self._fs, self._path = fs.FileSystem.from_uri(base)
        self._fs.create_dir(os.path.dirname(self._path), recursive=True)
        self._mark, self._kind = f".{uuid.uuid4().hex}.part", kind
        self._out, self._keys, self._sizes = self._fs.open_output_stream(self._path + ".ids" + self._mark), [], []

    def add(self, key: int | None, ids: bytes, n: int) -> None:
        self._out.write(ids)
        self._keys.append(_NULL_KEY if key is None else key)
        self._sizes.append(n)

    def close(self) -> tuple[int | None, int | None, int, int, int]:
        """Least and greatest key, records without a key, records, ids."""
        self._out.close()
        keys = np.array(self._keys, "<i8")
        distinct, first = np.unique(keys, return_index=True)
        displaced, slots = build_hash(distinct)
        prints, records = np.zeros(len(distinct), "<u4"), np.zeros(len(distinct), "<i4")
        prints[slots], records[slots] = _hashes(distinct)[2], first
        before = np.concatenate([[0], np.cumsum(np.array(self._sizes, "<i8"))]).astype("<i8")
        head = json.dumps({"format": 1, "ids": self._kind, "records": len(keys), "keys": len(distinct), "buckets": len(displaced)}).encode()
        with self._fs.open_output_stream(self._path + ".idx" + self._mark) as f:
            for part in (head.ljust(HEADER), keys, before, displaced.astype("<i4"), prints, records):
                f.write(part if isinstance(part, bytes) else part.tobytes())
        for end in (".ids", ".idx"):
            self._fs.move(self._path + end + self._mark, self._path + end)
        named = keys[keys != _NULL_KEY]
        low, high = (int(named.min()), int(named.max())) if len(named) else (None, None)
        return low, high, len(keys) - len(named), len(keys), int(before[-1])


class Tokens:
    """Ids of texts by a tokenizers file, remembering the units it has met; `end` follows each document.

    A unit is asked of the library once: its pre-tokeniser cuts it, its model
    merges the pieces. A unit of letters is one piece, so only its bytes need
    their stand-in characters. A text that can't be cut into units, or that
    holds a special token's string, goes to the library whole.
    """

    def __init__(self, path: str, end: int, remember: int = 600_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._of = Tokenizer.from_file(path)
        self._tokenize, self._cut = self._of.model.tokenize, self._of.pre_tokenizer.pre_tokenize_str
        self.kind = "<u2" if max(self._of.get_vocab_size(), end + 1) <= 2**16 else "<u4"
        self._code = "H" if self.kind == "<u2" else "I"
        self._special = [t.content for t in self._of.get_added_tokens_decoder().values()]
        self._end = self._pack([end])
        stands = {b: self._cut(chr(b))[0][0] for b in range(128) if b != 32}
        # Bytes over 127 only occur inside characters, whose stand-ins the pre-tokeniser gives one for each byte.
        for first in (*range(0x80, 0x800, 64), *range(0x80, 0xC0), *range(0x1000, 0xD000, 0x1000), *range(0xE000, 0x10000, 0x1000), *range(0x40000, 0x110000, 0x40000)):
            for byte, stand in zip(chr(first).encode(), self._cut("a" + chr(first))[-1][0][-len(chr(first).encode()) :]):
                stands[byte] = stand
        self._space = self._cut("a a")[1][0][0]
        self._stand = str.maketrans({chr(b): c for b, c in stands.items()})
        self._known, self._plain = Memo(self._marked, remember), Memo(self._unit, 50_000)

    def _pack(self, ids: list[int]) -> bytes:
        return array(self._code, ids).tobytes()

    def _unit(self, unit: str) -> bytes:
        return self._pack([t.id for piece, _ in self._cut(unit) for t in self._tokenize(piece)])

    def _marked(self, word: str) -> bytes:
        """Packed ids of a unit without the space before it, or of a newline and the unit after it."""
        if word.isalpha():
            stands = word if word.isascii() else word.encode().decode("latin-1").translate(self._stand)
            return array(self._code, [t.id for t in self._tokenize(self._space + stands)]).tobytes()
        if word[0] == "\n":
            return self._plain["\n"] + self._plain[word[1:]]
        cut = head_and_tail(word)
        return self._known[cut[0]] + self._plain[cut[1]] if cut else self._unit(" " + word)

    def _by_units(self, texts: pa.Array) -> list[bytes]:
        """Packed ids of texts that can be cut into units: each distinct unit of a batch is looked up once, and Arrow lays the ids out in the order of the units."""
        # Each newline, and one that is put before the text, gets a space before it, so that units are what stands between spaces.
        spaced = pc.binary_join_element_wise(pa.scalar("\n", texts.type), pc.replace_substring(texts, "\n", " \n"), pa.scalar("", texts.type))
        lists = pc.split_pattern(spaced, " ")
        coded = lists.flatten().dictionary_encode()
        found = list(map(self._known.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False)))
        ids = pa.array(found, pa.large_binary()).take(coded.indices)
        at = np.frombuffer(ids.buffers()[1], "<i8", len(ids) + 1, 8 * ids.offset)[lists.offsets.to_numpy()].tolist()
        whole, first = memoryview(ids.buffers()[2]), len(self._plain["\n"])
        return [bytes(whole[a + first : b]) for a, b in zip(at, at[1:])]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Packed ids of each text, with the end id."""
        texts = texts.cast(pa.large_string())
        cut = have_lone_spaces(texts)
        for special in self._special:
            cut = pc.and_(cut, pc.invert(pc.match_substring(texts, special)))
        units = iter(self._by_units(texts.filter(cut)))
        rest = (self._pack(e.ids) for e in (self._of.encode(t, add_special_tokens=False) for t in texts.filter(pc.invert(cut)).to_pylist()))
        return [(next(units) if c else next(rest)) + self._end for c in cut.to_pylist()]


@lru_cache(1)
def _tokens(path: str, end: int) -> Tokens:
    return Tokens(path, end)


def _gathered(batches: Iterator[pa.RecordBatch], size: int = GATHER) -> Iterator[tuple[list, pa.Array]]:
    """Keys and texts of batches put together until they hold `size` bytes, so that more of their units are the same."""
    keys, texts, n = [], [], 0
    for batch in batches:
        keys += batch.column(0).to_pylist()
        texts.append(batch.column(1))
        n += batch.nbytes
        if n >= size:
            yield keys, pa.concat_arrays(texts)
            keys, texts, n = [], [], 0
    if keys:
        yield keys, pa.concat_arrays(texts)


def write_index(docs: DataFrame, folder: str, tokenizer: str, end: int = 2, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Write the shards of (doc_id, text) below `folder`; returns the manifest, one row for each shard.

    Rows are dealt by ranges of doc_id, so shards ascend and each is sorted; it
    is the only shuffle, and it moves texts, which are smaller than their ids.
    A task streams its rows, so memory holds some megabytes of text and the shard's index.
    A task that is run again writes the same files and renames them into place.

    Null texts have only the end id. Null ids come first, under a reserved key.
    Repeated ids stand side by side and the index finds the first of them. An
    empty table gives one empty shard or none; extra columns are ignored.
    """
    spark = session_of(docs)
    parts = max(1, -(-docs.count() // shard_rows))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), clean_text().alias("text"))
    rows = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shard = _tokens(tokenizer, end), TaskContext.get().partitionId()
        base = f"{folder}/{shard:07d}"
        out, size = Writer(base, own.kind), np.dtype(own.kind).itemsize
        for keys, texts in _gathered(batches):
            for key, ids in zip(keys, own.encode(texts)):
                out.add(key, ids, len(ids) // size)
        low, high, nulls, n_docs, n_ids = out.close()
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [base], "low": pa.array([low], pa.int64()), "high": pa.array([high], pa.int64()), "nulls": pa.array([nulls], pa.int64()), "n_docs": pa.array([n_docs], pa.int64()), "n_ids": pa.array([n_ids], pa.int64())})

    manifest = staged(rows.mapInArrow(run, _MANIFEST), "manifest").where("n_docs > 0")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("ids_before", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_index(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of every record, each found by its key through the hash of its shard; ids are 32-bit bytes."""
    session_of(manifest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = Shard(base)
                keys = np.unique(shard.keys)
                for at in range(0, len(keys), 500):
                    ids, starts, names = [], [], []
                    asked = [None if key == _NULL_KEY else key for key in keys[at : at + 500].tolist()]
                    for key, records in zip(asked, shard.records_of(asked)):
                        for k in records:
                            names.append(key)
                            starts.append(start + int(shard.before[k]))
                            ids.append(shard.ids(k).astype("<u4").tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(starts, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "start", "ids"])

    shards = manifest.select("path", "ids_before", "shard").repartition(max(1, manifest.count()), "shard").select("path", "ids_before")
    return shards.mapInArrow(run, "doc_id long, start long, ids binary")


def fetch(keys: DataFrame, manifest: DataFrame) -> DataFrame:
    """(doc_id, ids) for the keys of a frame (doc_id) that the index of a manifest holds; absent keys give no row.

    Keys meet their shard by a range join with an equality: the key range is cut
    into as many cells as there are shards, and a shard is listed in the cells
    it touches, twice the shards at most. Each key then costs one hash, one
    fingerprint test and one read of the ids file.
    """
    session_of(keys)
    low, high, n = manifest.agg(F.min("low"), F.max("high"), F.count("*")).first()
    width = max(1, ((high or 0) - (low or 0)) // max(1, n))
    cell = lambda c: F.expr(f"{c} div {width}L")
    shards = manifest.where("low is not null").select("low", "high", "path", F.explode(F.sequence(cell("low"), cell("high"))).alias("cell"))
    asked = keys.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    named = asked.where("doc_id is not null").withColumn("cell", cell("doc_id")).join(shards, "cell").where(F.col("doc_id").between(F.col("low"), F.col("high"))).select("doc_id", "path")
    unnamed = manifest.where("nulls > 0").join(asked.where("doc_id is null")).select("doc_id", "path")  # one key at most
    dealt = named.union(unnamed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_shard = lru_cache(8)(Shard)
        for batch in batches:
            names, ids = [], []
            asked: dict[str, list] = {}
            for key, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                asked.setdefault(base, []).append(key)
            for base, own in asked.items():
                shard = open_shard(base)
                for key, records in zip(own, shard.records_of(own)):
                    names += [key] * len(records)
                    ids += [shard.ids(k).astype("<u4").tobytes() for k in records]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return dealt.select("doc_id", "path").repartition("path").sortWithinPartitions("path").mapInArrow(run, "doc_id long, ids binary")


def op9_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents' ids to indexed shards, then report every document from the files."""
    import public_tokenizers

    folder = f"{shared_dir(spark).rstrip('/')}/siftstone/tokens-{uuid.uuid4().hex}"
    manifest = write_index(documents(spark, sf_dir), folder, public_tokenizers.path("byte_bpe_50k.json"))
    ids = F.col("ids")
    return read_index(manifest).select("doc_id", "start", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.crc32(ids).alias("ids_crc32"))
