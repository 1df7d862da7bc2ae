"""Token-bounded chunks of rendered pages."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftstone.functions.arrow import parts

SIZE, OVERLAP, MAX_TOKENS = 500, 50, 500
Tokenize = Callable[[str], list[tuple[int, int]]]


def words(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in re.finditer(r"[^ \n\t\r]+", text)]


def _chunks(docs: DataFrame) -> T.StructType:
    """Rows of a chunk frame (doc_id as it is in the documents)."""
    return T.StructType([docs.schema["doc_id"], *(T.StructField(c, T.IntegerType()) for c in ("n", "start", "end", "n_tokens"))])


def _rows(ids: pa.Array, chunks: Iterable[Iterable[tuple[int, int, int]]]) -> pa.RecordBatch:
    """The chunks (start, end, tokens) of each document as rows, numbered within it."""
    rows = [(i, n, *c) for i, own in enumerate(chunks) for n, c in enumerate(own)]
    at, *columns = zip(*rows) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), *(pa.array(c, pa.int32()) for c in columns)], ["doc_id", "n", "start", "end", "n_tokens"])


def _named(chunks: DataFrame, scheme: str) -> DataFrame:
    return chunks.select(F.concat(F.lit(f"{scheme}:"), "doc_id", F.lit(":"), "n").alias("chunk_id"), "doc_id", "n", "start", "end", "n_tokens")


def fixed_chunks(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, tokenize: Tokenize = words) -> DataFrame:
    """(chunk_id, doc_id, n, start, end, n_tokens): windows of `size` tokens that never cross pages.

    Windows need the offsets of a page's tokens in order; as an Arrow function
    that is one pass over the page, some pages at a time, where a built-in form would shuffle a row
    for each token.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, "text"):
            yield _rows(part["doc_id"], (_windows(tokenize(text or ""), size, overlap) for text in part["text"].to_pylist()))

    return _named(docs.select("doc_id", "text").mapInArrow(run, _chunks(docs)), "fixed")


def paragraphs(text: str, base: int = 0) -> list[tuple[int, int]]:
    """Ranges between blank lines, without empty ones."""
    edges = [0, *chain.from_iterable(m.span() for m in re.finditer(r"\n\s*\n", text)), len(text)]
    return [(base + a, base + b) for a, b in zip(edges[::2], edges[1::2]) if a < b]


def _windows(spans: list[tuple[int, int]], size: int, overlap: int) -> Iterator[tuple[int, int, int]]:
    """The first, and then as many as the tokens after it need."""
    step = size - overlap
    more = max(0, -((size - len(spans)) // step))
    for k in range(1 + more if spans else 0):
        part = spans[k * step : k * step + size]
        yield part[0][0], part[-1][1], len(part)


def units(text: str, offsets: Sequence[int]) -> list[tuple[int, int, bool]]:
    """(start, end, body) of what is chunked together: a section with a body, after the headings without one that stand before it."""
    bounds = np.array([*offsets, len(text)])
    body = np.array([bool(text[a:b].partition("\n")[2].strip()) for a, b in zip(bounds, bounds[1:])], bool)
    group = np.cumsum(body) - body  # how many bodies came before: the same for a body and the headings it takes in
    last = np.flatnonzero(np.diff(group, append=-1))
    first = np.concatenate([[0], last[:-1] + 1]).astype(int) if len(last) else last
    return [(int(bounds[a]), int(bounds[b + 1]), bool(body[b])) for a, b in zip(first, last)]


def pack(sizes: Sequence[int], most: int) -> list[tuple[int, int]]:
    """Ranges of items, in order and as long as their sizes add up to at most `most`; larger items stand alone."""
    upto = np.concatenate([[0], np.cumsum(sizes)])
    large = [*np.flatnonzero(np.asarray(sizes) > most).tolist(), len(sizes)]
    out, at = [], 0
    while at < len(sizes):
        stop = large[bisect_left(large, at)]
        after = at + 1 if stop == at else min(stop, int(np.searchsorted(upto, upto[at] + most, side="right")) - 1)
        out.append((at, after))
        at = after
    return out


def pack_unit(text: str, start: int, end: int, tokenize: Tokenize, most: int, overlap: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, tokens) of a unit: whole if it fits, else paragraphs packed greedily, long ones cut into windows."""
    if (total := len(tokenize(text[start:end]))) <= most:
        yield start, end, total
        return
    held = paragraphs(text[start:end], start)
    spans = [tokenize(text[a:b]) for a, b in held]
    for i, j in pack([len(x) for x in spans], most):
        n = sum(map(len, spans[i:j]))
        if n > most:
            yield from ((held[i][0] + a, held[i][0] + b, k) for a, b, k in _windows(spans[i], most, overlap))
        else:
            yield held[i][0], held[j - 1][1], n


def section_chunks(pages: DataFrame, tokenize: Tokenize = words, most: int = MAX_TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of pages (doc_id, text, headings array<struct<offset>>): one a section, headings without a body joined to the next.

    A page is one unit of work in a part of an Arrow batch; pages need no shuffle. A
    heading without a body at the end of a page is a chunk of its own, of any
    size.
    """

    def chunks(text: str, offsets: Sequence[int]) -> Iterator[tuple[int, int, int]]:
        for start, end, body in units(text, offsets):
            if body:
                yield from pack_unit(text, start, end, tokenize, most, overlap)
            else:
                yield start, end, len(tokenize(text[start:end]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, "text"):
            yield _rows(part["doc_id"], (chunks(text, offsets) for text, offsets in zip(part["text"].to_pylist(), part["offsets"].to_pylist())))

    source = pages.select("doc_id", "text", F.transform("headings", lambda h: h["offset"]).alias("offsets"))
    return _named(source.mapInArrow(run, _chunks(pages)), "headings")


CHUNKERS = {"fixed": fixed_chunks, "headings": section_chunks}


def with_text(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    return chunks.join(docs.select("doc_id", "text"), "doc_id").withColumn("text", F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")))
