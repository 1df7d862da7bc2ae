"""Benchmark decontamination: BM25 over test items with block-max WAND, verified by overlap."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm.common import Memo, byte_texts, clean_text, documents, new_names, session_of, staged

K1, B = 1.2, 0.75
#: A passage is retrieved for an item if it holds this share of the item's own BM25 score.
THRESHOLD = 0.5
#: Share of the word pairs of an item's question, and of its answer, that a leak must hold.
OVERLAP = 0.6
#: The answer is this share of an item's words, from the end.
ANSWER = 1 / 3
#: Share of the threshold that the terms left out of the screening may add.
SPARE = 0.3
#: Postings of a block, whose largest impact lets a search skip it.
BLOCK = 16
#: Bytes of item text that one index may hold; more items make more indexes, asked one after another.
INDEX_BYTES = 32 << 20
_TRIM = re.compile(rb"\A[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+\Z")


def term_of(word: bytes) -> bytes:
    """A word without ASCII punctuation around it; a word of punctuation only stays."""
    return _TRIM.sub(b"", word) or word


def terms_of(text: bytes) -> list[bytes]:
    return [term_of(w) for w in text.lower().split()]


class Whole(NamedTuple):
    """What an index must know of all items, whichever it holds: their number, words, and longest; and the items of each of its terms."""

    n: int
    words: int
    longest: int
    df: dict[bytes, int]


def whole_of(items: list[tuple[int, bytes]]) -> Whole:
    sizes = [len(t) for _, text in items if (t := terms_of(text))]
    return Whole(len(sizes), sum(sizes), max(sizes, default=0), Counter(w for _, text in items for w in set(terms_of(text))))


class Index:
    """An inverted index of items, whose impacts are shares of the item's score against itself.

    A passage that holds all terms of an item has share 1 of it, so one
    threshold serves all items. Scores and passages follow from `whole`, so an
    item is found alike in an index of some items and of all.
    """

    def __init__(self, items: list[tuple[int, bytes]], threshold: float = THRESHOLD, overlap: float = OVERLAP, whole: Whole | None = None):
        self.threshold, self.overlap = threshold, overlap
        parsed = [(i, terms) for i, text in sorted(items) if (terms := terms_of(text))]
        self.items, self.words = [i for i, _ in parsed], [t for _, t in parsed]
        every, words, self.longest, known = whole or whole_of(items)
        counts = [Counter(t) for t in self.words]
        n, mean = len(parsed), words / max(1, every)
        df = {w: known[w] for c in counts for w in c}
        idf = {w: math.log(1 + (every - d + 0.5) / (d + 0.5)) for w, d in df.items()}
        self.ids = {w: k for k, w in enumerate(df)}
        self.memo = Memo(lambda w: self.ids.get(term_of(w), -1))
        shares = []
        for c, words in zip(counts, self.words):
            norm = K1 * (1 - B + B * len(words) / mean)
            raw = {w: idf[w] * tf * (K1 + 1) / (tf + norm) for w, tf in c.items()}
            total = sum(raw.values())
            shares.append({w: x / total for w, x in raw.items()})
        postings: list[list[tuple[int, float]]] = [[] for _ in df]
        for item, share in enumerate(shares):
            for w, x in share.items():
                postings[self.ids[w]].append((item, x))
        self.at = [np.array([i for i, _ in p], np.int32) for p in postings]
        self.impact = [np.array([x for _, x in p]) for p in postings]
        self.most = [float(x.max()) for x in self.impact]
        self.block_most = [np.maximum.reduceat(x, np.arange(0, len(x), BLOCK)) for x in self.impact]
        # The terms of an item, rarest first, until the rest is a small part of the threshold: what a passage is screened by.
        need: list[list[tuple[int, float]]] = [[] for _ in df]
        self.spare = np.zeros(n)
        for item, share in enumerate(shares):
            rest = 1.0
            for w in sorted(share, key=lambda w: (df[w], -share[w], w)):
                if rest < SPARE * threshold:
                    break
                need[self.ids[w]].append((item, share[w]))
                rest -= share[w]
            self.spare[item] = max(0.0, rest)
        self._need_from = np.concatenate([[0], np.cumsum([len(x) for x in need])]).astype(np.int64)
        self._need_item = np.array([i for x in need for i, _ in x], np.int64)
        self._need_share = np.array([s for x in need for _, s in x])
        self.halves = []
        for words in self.words:
            cut = len(words) - max(1, round(len(words) * ANSWER))
            self.halves.append((self._grams(words[:cut]), self._grams(words[cut:])))

    @staticmethod
    def _grams(words: list[bytes]) -> set[tuple[bytes, ...]]:
        return set(zip(words, words[1:])) if len(words) > 1 else {(w,) for w in words}

    def windows(self, n: int) -> list[tuple[int, int]]:
        """Passages of a text of n words: twice the longest item, half overlapping, so that any item lies whole in one."""
        step = max(1, self.longest)
        return [(s, min(n, s + 2 * step)) for s in range(0, max(1, n - step), step)]

    def plausible(self, ids: np.ndarray) -> np.ndarray:
        """Starts (in steps) of the passages whose needed terms alone could reach the threshold for some item."""
        place = np.flatnonzero(ids >= 0)
        n, t = len(self.items), len(self._need_from)
        half = place // max(1, self.longest) + 1
        met = np.unique(np.concatenate([half, half - 1]) * t + np.tile(ids[place], 2))  # each term once for each passage
        at, term = met // t, met % t
        size = self._need_from[term + 1] - self._need_from[term]
        pick = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self._need_from[term], size)
        cell, share = np.repeat(at, size) * n + self._need_item[pick], self._need_share[pick]
        if len(half) and (half[-1] + 1) * n > 4 * len(cell) + 100_000:  # many items: only the cells that are met
            cells, cell = np.unique(cell, return_inverse=True)
        else:
            cells = np.arange(cell.max(initial=-1) + 1)
        mass = np.bincount(cell, weights=share, minlength=len(cells))
        return np.unique(cells[mass >= self.threshold - self.spare[cells % n] - 1e-9] // n) - 1

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """All (item, share) at or above the threshold for a passage of distinct terms, by block-max WAND."""
        cursors = [[0, t] for t in terms]
        found, floor = [], self.threshold - 1e-9
        while True:
            cursors = [c for c in cursors if c[0] < len(self.at[c[1]])]
            cursors.sort(key=lambda c: self.at[c[1]][c[0]])
            bound, pivot = 0.0, None
            for k, (_, t) in enumerate(cursors):
                bound += self.most[t]
                if bound >= floor:
                    pivot = k
                    break
            if pivot is None:
                return found
            item = int(self.at[cursors[pivot][1]][cursors[pivot][0]])
            while pivot + 1 < len(cursors) and self.at[cursors[pivot + 1][1]][cursors[pivot + 1][0]] == item:
                pivot += 1
            bound, after = 0.0, len(self.items)
            for c in cursors[: pivot + 1]:
                p = int(np.searchsorted(self.at[c[1]], item))
                if p < len(self.at[c[1]]):
                    block = p // BLOCK
                    bound += float(self.block_most[c[1]][block])
                    last = min(len(self.at[c[1]]), (block + 1) * BLOCK) - 1
                    after = min(after, int(self.at[c[1]][last]) + 1)
            if bound >= floor:
                score = 0.0
                for c in cursors[: pivot + 1]:
                    p = int(np.searchsorted(self.at[c[1]], item))
                    if p < len(self.at[c[1]]) and self.at[c[1]][p] == item:
                        score += float(self.impact[c[1]][p])
                if score >= floor:
                    found.append((item, score))
                goal = item + 1
            else:
                if pivot + 1 < len(cursors):
                    after = min(after, int(self.at[cursors[pivot + 1][1]][cursors[pivot + 1][0]]))
                goal = max(after, item + 1)
            for c in cursors[: pivot + 1]:
                c[0] = max(c[0], int(np.searchsorted(self.at[c[1]], goal)))

    def leaks(self, text: bytes) -> dict[int, float]:
        """Best share of each item that a text leaks: retrieved, and question and answer overlap."""
        words = text.lower().split()
        if not words or not self.items:
            return {}
        ids = np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))
        found: dict[int, float] = {}
        step, last = max(1, self.longest), len(self.windows(len(words))) - 1
        for at in sorted({min(max(0, int(k)), last) for k in self.plausible(ids)}):
            part = slice(at * step, at * step + 2 * step)
            known = ids[part]
            hits = self.search(np.unique(known[known >= 0]).tolist())
            if hits:
                own = [term_of(w) for w in words[part]]
                for item, share in hits:
                    if share > found.get(item, 0.0) and self._holds(own, item):
                        found[item] = share
        return {self.items[k]: share for k, share in found.items()}

    def _holds(self, words: list[bytes], item: int) -> bool:
        """Whether a stretch of a passage, twice as long as the item, has the overlap with its question and its answer."""
        step = len(self.words[item])
        for at in range(0, max(1, len(words) - step), step):
            grams = self._passage_grams(words[at : at + 2 * step])
            if all(len(h & grams) >= self.overlap * len(h) for h in self.halves[item]):
                return True
        return False

    @staticmethod
    def _passage_grams(words: list[bytes]) -> set[tuple[bytes, ...]]:
        return set(zip(words, words[1:])) | {(w,) for w in words}


_TERMS = "term binary, items long, words long, longest long"


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct terms of each item, and its length under no term."""
    for batch in batches:
        for text in byte_texts(batch.column(0)):
            if terms := terms_of(text):
                own = [None, *set(terms)]
                none = [0] * (len(own) - 1)
                yield pa.RecordBatch.from_pydict({"term": pa.array(own, pa.binary()), "items": pa.array([1] * len(own), pa.int64()), "words": pa.array([len(terms), *none], pa.int64()), "longest": pa.array([len(terms), *none], pa.int64())})


def _blocks(benchmark: DataFrame, limit: int) -> Iterator[tuple[list[tuple[int, bytes]], Whole]]:
    """The items in lists of about `limit` bytes of text at most, one read after another, with what each must know of all."""
    rows = staged(benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")), "items")
    known = staged(rows.select(F.col("text").cast("string")).mapInArrow(_item_terms, _TERMS).groupBy("term").agg(F.sum("items").alias("items"), F.sum("words").alias("words"), F.max("longest").alias("longest")), "terms")
    every = known.where("term is null").first()
    n, words, longest = (every["items"], every["words"], every["longest"]) if every else (0, 0, 0)
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-total // limit))
    for k in range(parts):
        own = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k)
        held = known.where("term is not null") if parts == 1 else own.select(F.col("text").cast("string")).mapInArrow(_item_terms, _TERMS).where("term is not null").select("term").distinct().join(known, "term")
        yield [(r[0], bytes(r[1])) for r in own.collect()], Whole(n, words, longest, {bytes(r["term"]): r["items"] for r in held.select("term", "items").collect()})


def _asked(shared, threshold: float, overlap: float, name: str):
    hits = pa.list_(pa.struct([("item", pa.int64()), ("share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, whole = shared.value
        index = Index(items, threshold, overlap, whole)
        for batch in batches:
            k = batch.schema.get_field_index(name)
            old = batch.column(k).to_pylist()
            new = [[*(o or []), *({"item": i, "share": s} for i, s in sorted(index.leaks(t).items()))] for o, t in zip(old, byte_texts(batch.column(batch.schema.get_field_index("text"))))]
            yield batch.set_column(k, name, pa.array(new, hits))

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, limit: int = INDEX_BYTES, name: str = "leaks") -> DataFrame:
    """The rows of a frame with a column `name`: the items each whole text leaks, with their shares.

    Every passage of every text is a query. Indexes of at most `limit` bytes of
    items are sent to the tasks, as many as the benchmark needs, and texts pass
    through them without a shuffle; the number of indexes changes no result.
    Null and empty texts leak nothing; null or empty items are never leaked;
    equal items are each reported; null ids and repeated rows each return a row;
    other columns are passed on, and one that has the name is replaced.
    """
    spark = session_of(docs)
    out = docs.withColumn(name, F.expr("cast(array() as array<struct<item:bigint,share:double>>)"))
    for block in _blocks(benchmark, limit):
        out = out.mapInArrow(_asked(spark.sparkContext.broadcast(block), threshold, overlap, name), out.schema)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of a frame whose texts leak no item; columns may have any name."""
    (name,) = new_names(docs, "leaks")
    return find_leaks(docs, benchmark, name=name).where(F.size(name) == 0).drop(name)


def op6_block_max_wand(spark, sf_dir: str) -> DataFrame:
    """The benchmark items that each document leaks."""
    found = find_leaks(documents(spark, sf_dir).select("doc_id", clean_text().alias("text")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaks = F.col("leaks")
    items = F.array_join(F.array_sort(F.transform(leaks, lambda x: x["item"])).cast("array<string>"), ",")
    return found.select("doc_id", F.size(leaks).cast("long").alias("n_items"), items.alias("items"), F.coalesce(F.array_max(F.transform(leaks, lambda x: x["share"])), F.lit(0.0)).alias("best_share"), (F.size(leaks) > 0).alias("contaminated"))
