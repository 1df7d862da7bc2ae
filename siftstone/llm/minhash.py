"""Near-duplicate classes by circulant MinHash, banding and exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm.common import Memo, clean_text, documents, mix64, new_names, session_of, staged, word_codes
from siftstone.llm.components import components

#: Odd multipliers that make a shingle's hash depend on the order of its words.
_ORDER = np.array([0x9E3779B97F4A7C15 * (2 * i + 1) % 2**64 | 1 for i in range(64)], dtype=np.uint64)
#: The step of the circular shift: coordinate k shifts by k times this, modulo 2**32.
_STEP = 0x9E3779B1
#: Coordinates computed at a time, so that a block stays in the CPU's cache.
_BLOCK = 48


def shingles(hashes: np.ndarray, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text, from the hashes of its words.

    A text with fewer words than a shingle is one shingle; without words the set is empty.
    """
    if not len(hashes):
        return np.empty(0, dtype=np.uint64)
    n = min(words, len(hashes))
    s = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
    for i in range(n):
        s += hashes[i : len(hashes) - n + 1 + i] * _ORDER[i]
    return np.unique(mix64(s + np.uint64(n)))


def shingle_sets(texts: pa.Array, words: int, memo: Memo) -> Iterator[np.ndarray]:
    """The shingles of each text of a column, whose words are runs without ASCII white space, A-Z lower-cased."""
    codes, sizes, names = word_codes(texts)
    hashes = np.fromiter(map(memo.__getitem__, names), np.uint64, len(names))[codes]
    for end, size in zip(np.cumsum(sizes).tolist(), sizes.tolist()):
        yield shingles(hashes[end - size : end], words)


def word_memo() -> Memo:
    return Memo(lambda w: xxhash.xxh3_64_intdigest(w))


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash of a non-empty set.

    Two permutations of the 32-bit integers: the first scatters the shingles
    once; the second, read at a circularly shifted place, gives coordinate k as
    min over x of second((first(x) + shift_k) mod 2**32).
    """
    first = (shingles >> np.uint64(16)).astype(np.uint32)
    first ^= first >> np.uint32(16)
    first *= np.uint32(0x7FEB352D)
    first ^= first >> np.uint32(15)
    first *= np.uint32(0x846CA68B)
    first ^= first >> np.uint32(16)
    shifts = (np.arange(coordinates, dtype=np.uint64) * np.uint64(_STEP)).astype(np.uint32)
    out = np.full(coordinates, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(first), 2048):
        part = first[at : at + 2048]
        for k in range(0, coordinates, _BLOCK):
            x = part[None, :] + shifts[k : k + _BLOCK, None]
            x ^= x >> np.uint32(16)
            x *= np.uint32(0x85EBCA6B)
            x ^= x >> np.uint32(13)
            x *= np.uint32(0xC2B2AE35)
            np.minimum(out[k : k + _BLOCK], x.min(axis=1), out=out[k : k + _BLOCK])
    return out


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of `rows` coordinates, different for each band."""
    grouped = sig.reshape(-1, rows).astype(np.uint64)
    keys = np.arange(len(grouped), dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for i in range(rows):
        keys = mix64(keys ^ (grouped[:, i] + np.uint64(0x9E3779B97F4A7C15)))
    return keys.view(np.int64)


_SKETCH = "doc_id long, text_key long, n_shingles long, set_key binary, bands array<long>"
_SETS = "node long, shingles array<long>, odd array<long>"
#: Members of a bucket that are compared in one task; larger buckets are dealt out.
_PART = 1024
#: 64-bit words of an odd sketch.
_ODD = 32


def odd_sketch(shingles: np.ndarray) -> np.ndarray:
    """A bitmap in which every shingle flips one bit.

    Two bitmaps differ in at most as many bits as the sets have shingles not in
    common, so a bound on their difference never rejects a similar pair.
    """
    bits = np.bincount((mix64(shingles) % np.uint64(64 * _ODD)).astype(np.int64), minlength=64 * _ODD) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def set_key(found: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None


def _sketches(words: int, rows: int, bands: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_memo()
        for batch in batches:
            sizes, keys, found = [], [], []
            for s in shingle_sets(batch.column(2), words, memo):
                sizes.append(len(s))
                keys.append(set_key(s))
                found.append(band_keys(signature(s, rows * bands), rows) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(found, pa.list_(pa.int64()))], schema=schema)

    return run


def _shingle_rows(words: int):
    """The sets of (node, set_key, text) whose text has the set of the key."""
    longs = pa.list_(pa.int64())
    schema = pa.schema([("node", pa.int64()), ("shingles", longs), ("odd", longs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_memo()
        for batch in batches:
            sets = list(shingle_sets(batch.column(2), words, memo))
            own = [k for k, (s, key) in enumerate(zip(sets, batch.column(1).to_pylist())) if set_key(s) == key]
            nodes = batch.column(0).take(pa.array(own, pa.int64()))
            yield pa.RecordBatch.from_arrays([nodes, pa.array([sets[k].view(np.int64) for k in own], longs), pa.array([odd_sketch(sets[k]) for k in own], longs)], schema=schema)

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of candidate pairs (u, v), those whose full sets are similar enough."""
    a = sets.select(F.col("node").alias("u"), F.col("shingles").alias("su"))
    b = sets.select(F.col("node").alias("v"), F.col("shingles").alias("sv"))
    both = F.size(F.array_intersect("su", "sv"))
    joined = pairs.join(b.hint("merge"), "v").join(a.hint("merge"), "u")
    return joined.where(100 * both >= percent * (F.size("su") + F.size("sv") - both)).select("u", "v")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (node, label) after joining the classes that links (u, v) connect."""
    ends = [labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")) for c in "uv"]
    moved = components(links.join(ends[0], "u").join(ends[1], "v").select(F.col("lu").alias("u"), F.col("lv").alias("v")))
    return staged(labels.join(moved.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")


def _dealt(rows: DataFrame, copies: bool) -> DataFrame:
    """The members of open buckets with the part of their bucket they are compared in: each in one, or in all as a copy."""
    parts = F.ceil(F.col("size") / _PART)
    part = F.explode(F.sequence(F.lit(0), parts.cast("int") - 1)) if copies else F.pmod(F.xxhash64("node"), parts).cast("int")
    return rows.withColumn("part", part)


class _Classes(NamedTuple):
    """Rows (doc_id, text_key, n_shingles, node), distinct sets (node, doc), and the class (node, label) of every set."""

    placed: DataFrame
    nodes: DataFrame
    labels: DataFrame


def text_classes(docs: DataFrame, words: int, percent: int, rows: int, bands: int, rounds: int) -> _Classes:
    """Classes of distinct shingle sets that links of similarity connect; see near_duplicates."""
    session_of(docs)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(clean_text()).alias("text_key"), clean_text().alias("text"))
    sketches = staged(source.mapInArrow(_sketches(words, rows, bands), _SKETCH), "sketches")
    named = sketches.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("doc"), F.min("n_shingles").alias("n"), F.min("text_key").alias("text_key"), F.first("bands").alias("bands"))
    nodes = staged(named.withColumn("node", F.monotonically_increasing_id()), "nodes")  # the numbers are as written
    spread = nodes.select("node", "n", F.explode("bands").alias("band"))
    shared = spread.groupBy("band").agg(F.count("*").alias("size")).where("size > 1").select("band")
    members = staged(spread.join(shared, "band").distinct(), "buckets")
    labels = staged(members.select("node", F.col("node").alias("label")).distinct(), "labels")
    wanted = nodes.join(labels, "node", "left_semi").select("node", "set_key", F.col("text_key").alias("key"))
    texts = source.select("text_key", "text").join(wanted.hint("merge"), F.col("text_key") == F.col("key")).select("node", "set_key", "text")
    sets = staged(texts.dropDuplicates(["node"]).mapInArrow(_shingle_rows(words), _SETS), "sets")

    tested = None
    for turn in range(rounds + 1):
        labelled = members.join(labels, "node")
        spans = [F.min("label").alias("low"), F.max("label").alias("high")]
        if turn < rounds:
            drawn = F.xxhash64("node", "band", F.lit(turn)) if turn else F.lit(0)
            pivot = F.min(F.struct(drawn.alias("drawn"), "node", "n", "label")).alias("pivot")
            a = labelled.groupBy("band").agg(*spans, pivot).where("low < high").select("band", *(F.col(f"pivot.{c}").alias(f"{c}a") for c in ("node", "n", "label")))
            b = labelled.select("band", *(F.col(c).alias(f"{c}b") for c in ("node", "n", "label")))
            on, test = ["band"], "labela <> labelb"
        else:
            split = labelled.groupBy("band").agg(*spans, F.count("*").alias("size")).where("low < high").select("band", "size")
            odd = staged(labelled.join(split, "band"), "open").join(sets.select("node", "odd").hint("merge"), "node")
            apart = " + ".join(f"bit_count(get(odda, {i}) ^ get(oddb, {i}))" for i in range(_ODD))
            a, b = (_dealt(odd, side == "a").select("band", "part", *(F.col(c).alias(c + side) for c in ("node", "n", "label", "odd"))) for side in "ab")
            on, test = ["band", "part"], f"nodea < nodeb and labela <> labelb and {100 + percent} * ({apart}) <= {100 - percent} * (na + nb)"
        met = a.join(b.hint("merge"), on).where(test).where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
        pairs = met.select(F.least("nodea", "nodeb").alias("u"), F.greatest("nodea", "nodeb").alias("v")).distinct()
        pairs = staged(pairs if tested is None else pairs.join(tested, ["u", "v"], "left_anti"), "pairs")
        tested = pairs if tested is None else tested.union(pairs)
        labels = _merged(labels, _verified(pairs, sets, percent))

    placed = staged(sketches.select("doc_id", "text_key", "n_shingles", "set_key").join(nodes.select("set_key", "node"), "set_key", "left").drop("set_key"), "placed")
    every = nodes.select("node").join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    return _Classes(placed, nodes.select("node", "doc"), every)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, rows: int = 6, bands: int = 40, rounds: int = 3) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of (doc_id, text).

    Documents whose shingle sets have 100 * intersection >= percent * union are
    linked; component_id is the least doc_id reachable.

    * Equal sets are one node, so copies never meet in pairs.
    * A band bucket is first compared as a star around one member, in `rounds`
      rounds: the least, then ones drawn by hash, another in each bucket. Nodes
      that links connect share a class and need no further comparison.
    * Then every pair of a bucket that is still in different classes is
      compared, without a cap, so no link between candidates is lost. Odd
      sketches, whose difference never exceeds that of the sets, keep the pairs
      that can't be similar from being made.
    * There, members of a large bucket are dealt out to parts; what they are
      compared with is copied to each part. A star needs one row a member.
    * Every link is confirmed on the full sets of 64-bit shingle hashes.

    With 40 bands of 6 rows a pair at the 0.8 threshold shares no band with
    probability (1 - 0.8**6)**40 = 5e-6, and less above it.

    Null and empty texts have no shingles and are linked with nothing. Rows with
    one doc_id are one document: whatever any of its texts is linked with is
    linked with all. A null doc_id is never a representative while its class
    holds an id; a class of null ids only has component_id null and is kept.
    Extra columns are ignored; repeated rows each return a row; an empty table
    gives an empty result.
    """
    placed, nodes, labels = text_classes(docs, words, percent, rows, bands, rounds)
    named = placed.where("doc_id is not null and node is not null")
    several = named.groupBy("doc_id").agg(F.min("node").alias("v"), F.max("node").alias("high")).where("v < high").select("doc_id", "v")
    links = staged(named.join(several, "doc_id").where("node > v").select(F.col("node").alias("u"), "v").distinct(), "same")
    if not links.isEmpty():
        labels = _merged(staged(labels, "labels"), links)
    least = labels.join(nodes, "node").groupBy("label").agg(F.min("doc").alias("component_id"))
    classes = labels.join(least, "label").select("node", "component_id")
    return placed.join(classes, "node", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(F.col("node").isNull(), F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept"),
    )


def representatives(docs: DataFrame, words: int = 5, percent: int = 80, rows: int = 6, bands: int = 40, rounds: int = 3) -> DataFrame:
    """One row of each class of near-duplicate texts of a frame, with all its columns.

    The row with the least doc_id stays, a null id only where the class holds
    none. Texts are classed by similarity alone, so two different texts under
    one doc_id both stay. Of rows without words, one stays for each id and text.
    """
    placed, _, labels = text_classes(docs, words, percent, rows, bands, rounds)
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")
    best = placed.join(labels, "node").groupBy("label").agg(F.min(row).alias("row")).select("row.doc_id", "row.text_key")
    stay = best.unionByName(placed.where("node is null").select("doc_id", "text_key").distinct())
    key, at = new_names(docs, "text_key", "row_id")
    rows = docs.withColumns({key: F.xxhash64(clean_text()), at: F.col("doc_id").cast("long")})
    same = rows[key].eqNullSafe(F.col("kept_text")) & rows[at].eqNullSafe(F.col("kept_id"))
    kept = rows.join(stay.select(F.col("doc_id").alias("kept_id"), F.col("text_key").alias("kept_text")).hint("merge"), same, "left_semi")
    return kept.dropDuplicates([at, key]).drop(key, at)


def op7_circulant_minhash(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents on four-word shingles."""
    return near_duplicates(documents(spark, sf_dir), words=4)
