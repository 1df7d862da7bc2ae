"""Byte-level BPE: overlapping chunk encoding and raw-byte decoding."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm.common import Memo, clean_text, documents, in_turn, session_of
from siftstone.llm.pretokens import head_and_tail, units

#: Texts of more code points are cut into chunks that are pre-tokenised in parallel.
LONG = 32_768
#: Code points of a chunk, and of the overlap in which two chunks must resynchronise.
CHUNK, OVERLAP = 16_384, 512


class Codec:
    """Encodes and decodes with the ranks of a file and a pre-token pattern."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._merge = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.find = regex.compile(pattern)
        self.bytes_of = {i: b for b, i in ranks.items()}
        self._memo = Memo(self._unit)

    def _unit(self, unit: str) -> bytes:
        if cut := head_and_tail(unit):
            return self._memo[cut[0]] + self._memo[cut[1]]
        return np.array([i for piece in self.find.findall(unit) for i in self._merge(piece)], dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers; each match of the pattern is merged separately."""
        cut = units(text)
        return b"".join(map(self._memo.__getitem__, self.find.findall(text) if cut is None else cut))

    def decode(self, ids: list[int]) -> bytes:
        """The raw bytes of the ids; they need not be whole characters."""
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker process and vocabulary."""
    return Codec(path, pattern)


def boundaries(find, text: str) -> list[int]:
    """Where pre-tokens begin, for those whose beginning cannot change with what follows the text."""
    return [0, *(end for m in find.finditer(text) if (end := m.end()) < len(text))]


def stitch(chunks: list[tuple[int, int, list[int], list[int]]]) -> list[tuple[int, int | None]]:
    """Pieces (start, end) of a text from its chunks (index, start, head, tail), in order.

    head and tail hold the boundaries each chunk found in the overlap with the
    chunk before and after it. The first boundary both see is a true one, and
    from there on the later chunk is right. Where they share none the later
    chunk can't be trusted: what follows the last good cut stays one piece.
    """
    cuts = [0]
    for before, after in zip(chunks, chunks[1:]):
        both = sorted(set(before[3]) & set(after[2]))
        if not both:
            break
        cuts.append(both[0])
    return list(zip(cuts, [*cuts[1:], None]))


def _encoded(path: str, pattern: str, keep: int):
    """Encode the last column of a batch; the `keep` columns before it are passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            ids = pa.array([own.encode(t or "") for t in batch.column(keep).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], ids], names=[*batch.schema.names[:keep], "ids"])

    return run


def _chunked(chunk: int, overlap: int):
    schema = pa.schema([("key", pa.string()), ("ix", pa.int32()), ("at", pa.int32()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                starts = range(0, max(1, len(text) - overlap), chunk)
                for at in range(0, len(starts), 64):
                    some = starts[at : at + 64]
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(some)), pa.array(range(at, at + len(some)), pa.int32()), pa.array(some, pa.int32()), pa.array([text[s : s + chunk + overlap] for s in some])], schema=schema)

    return run


def _marked(path: str, pattern: str, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = codec(path, pattern).find
        for batch in batches:
            heads, tails = [], []
            for at, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                found = boundaries(find, text)
                heads.append([at + x for x in found if x < overlap])
                tails.append([at + x for x in found if x >= len(text) - overlap])
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(heads, ints), pa.array(tails, ints)], names=["key", "ix", "at", "head", "tail"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("key", pa.string()), ("ix", pa.int32()), ("text", pa.string())])
    for batch in batches:
        for key, text, marks in zip(*(c.to_pylist() for c in batch.columns)):
            pieces = stitch([(m["ix"], m["at"], m["head"], m["tail"]) for m in marks])
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(pieces)), pa.array(range(len(pieces)), pa.int32()), pa.array([text[a:b] for a, b in pieces])], schema=schema)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        whole = [b"".join(x["ids"] for x in parts) for parts in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(whole, pa.binary())], names=["key", "ids"])


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n_tokens, ids as a list) of (key, ids as bytes)."""
    for batch in batches:
        blobs = [x or b"" for x in batch.column(1).to_pylist()]
        sizes = np.array([len(x) // 4 for x in blobs], np.int64)
        ids = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), np.frombuffer(b"".join(blobs), "<i4"))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), ids], names=[batch.schema.names[0], "n_tokens", "ids"])


def encode_texts(docs: DataFrame, path: str, pattern: str, long: int = LONG, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids): the token ids of every whole text as little-endian 32-bit bytes; see _encoded_as."""
    return _encoded_as(docs, path, pattern, long, chunk, overlap, iter, "ids binary")


def encode_arrays(docs: DataFrame, path: str, pattern: str, long: int = LONG, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_tokens, ids array<int>): id_arrays of encode_texts, made where texts are encoded; see _encoded_as."""
    return _encoded_as(docs, path, pattern, long, chunk, overlap, _arrays, "n_tokens long, ids array<int>")


def _encoded_as(docs: DataFrame, path: str, pattern: str, long: int, chunk: int, overlap: int, then, kind: str) -> DataFrame:
    """doc_id and the columns `kind` that `then` makes of the token ids of every whole text.

    Texts of up to `long` code points are one chunk and are encoded in place,
    without a shuffle. Longer ones are cut into overlapping chunks that are
    pre-tokenised in parallel, stitched where their boundaries resynchronise,
    and the pieces between the stitches are encoded in parallel. Where no
    boundary is shared (a run of one character class longer than the overlap)
    the rest of the text is one piece, so ids are right for any text.

    Null texts count as empty and have no ids; null ids and repeated rows are
    passed on, equal long texts are encoded once; extra columns are ignored.
    """
    session_of(docs)
    rows = docs.select("doc_id", clean_text().alias("text"))
    short = rows.where(F.length("text") <= long).mapInArrow(in_turn(_encoded(path, pattern, 1), then), f"doc_id long, {kind}")
    keyed = rows.where(F.length("text") > long).select("doc_id", F.sha2("text", 256).alias("key"), "text")
    texts = keyed.select("key", "text").dropDuplicates(["key"])
    chunks = texts.mapInArrow(_chunked(chunk, overlap), "key string, ix int, at int, text string").repartition("key", "ix")
    marks = chunks.mapInArrow(_marked(path, pattern, overlap), "key string, ix int, at int, head array<int>, tail array<int>")
    marks = marks.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("ix", "at", "head", "tail"))).alias("marks"))
    pieces = texts.join(marks.hint("merge"), "key").select("key", "text", "marks").mapInArrow(_cut, "key string, ix int, text string").repartition("key", "ix")
    parts = pieces.mapInArrow(_encoded(path, pattern, 2), "key string, ix int, ids binary")
    whole = parts.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("ix", "ids"))).alias("parts")).mapInArrow(in_turn(_joined, then), f"key string, {kind}")
    return short.union(keyed.select("doc_id", "key").join(whole.hint("merge"), "key").drop("key"))


def decode_ids(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, raw): the bytes that the ids of (doc_id, ids) stand for, concatenated; null ids give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            raw = [own.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["doc_id", "raw"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, raw binary")


def digests(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of (doc_id, ids), decoding the ids on the way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        names = {i: str(i) for i in own.bytes_of}
        for batch in batches:
            n, shas, raws = [], [], []
            for blob in batch.column(1).to_pylist():
                ids = np.frombuffer(blob, "<u4").tolist()
                n.append(len(ids))
                shas.append(hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest())
                raws.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(shas), pa.array(raws)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def id_arrays(encoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids array<int>) of (doc_id, ids)."""
    return encoded.select("doc_id", "ids").mapInArrow(_arrays, "doc_id long, n_tokens long, ids array<int>")


def vocabulary() -> tuple[str, str]:
    """The rank file and the pattern the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op3_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and decoded bytes of all documents."""
    path, pattern = vocabulary()
    return digests(encode_texts(documents(spark, sf_dir), path, pattern), path, pattern)
