"""Language-model scoring with a weighted backoff automaton, block by block."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs
from pyspark import TaskContext
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm.common import Memo, clean_text, documents, id_crc32, mix64, session_of, shared_dir, staged, word_codes

#: The token that ends a text, and that stands before its first one; no word can be a newline.
END = b"\n"
#: Weight added to each count of a single token.
SMOOTH = 0.1
#: Tokens that a state gives to the state it fails to: for states of one word, and of two.
BACKOFF = (1000.0, 16.0)
#: Tokens of a block of texts, and bytes of text for each part of the counts; both only bound a worker's memory.
BLOCK_TOKENS, PART_BYTES = 1 << 21, 8 << 20
_ORDER = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
_KEYS = 1 << 63
_CHANGED = "the texts of a block are not those that were counted"
_RETRIES = 3
_ASKED = "part int, task int, block int, ord int, mark long, blob binary"


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


class Block:
    """The tokens of some texts in one array, each text between two ends, and the keys of their n-grams.

    A key is a 63-bit hash of one, two or three tokens; the last of them is the
    token read, and those before it are the state it is read in.
    """

    def __init__(self, hashes: np.ndarray, sizes: np.ndarray):
        text = np.repeat(np.arange(len(sizes)), sizes)
        self.sizes = sizes + 1
        self.first = np.concatenate([[0], np.cumsum(sizes + 2)])[:-1]
        self.flat = np.full(len(hashes) + 2 * len(sizes), word_hash(END), np.uint64)
        self.flat[np.arange(len(hashes)) + 2 * text + 1] = hashes
        inside = np.ones(len(self.flat), bool)
        inside[self.first] = False
        #: Places of the tokens to read, and of those with two tokens before them in their text.
        self.read = np.flatnonzero(inside)
        self.deep = self.read[inside[self.read - 1]]

    def places(self, order: int) -> np.ndarray:
        return self.deep if order == 3 else self.read

    def keys(self, order: int) -> np.ndarray:
        at = self.places(order)
        key = np.full(len(at), order, np.uint64)
        for k in range(order):
            key += self.flat[at - k] * _ORDER[k]
        return mix64(key) >> np.uint64(1)

    def of_text(self, order: int, values: np.ndarray) -> np.ndarray:
        """A value of each text for each of its places."""
        return np.repeat(values, self.sizes - (order == 3))


def blocks(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple[Block, list[pa.Array]]]:
    """Blocks of at least `least` tokens, in the order of the rows, with the columns beside the text, which is the last."""
    memo = Memo(word_hash)
    held, rest, n = [], [], 0

    def out() -> tuple[Block, list[pa.Array]]:
        own = Block(np.concatenate([h for h, _ in held]), np.concatenate([s for _, s in held]))
        columns = [pa.concat_arrays(c) for c in zip(*rest)]
        held.clear()
        rest.clear()
        return own, columns

    for batch in batches:
        if batch.num_rows:
            codes, sizes, names = word_codes(batch.column(batch.num_columns - 1))
            held.append((np.fromiter(map(memo.__getitem__, names), np.uint64, len(names))[codes], sizes))
            rest.append(batch.columns[:-1])
            n += len(codes) + len(sizes)
            if n >= least:
                yield out()
                n = 0
    if held:
        yield out()


def _heads(ordered: np.ndarray) -> np.ndarray:
    """Where each value of a sorted array first stands."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)


def _bounds(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each part of the range of keys begins in sorted keys; the last number is their count."""
    starts = np.array([k * _KEYS // parts for k in range(1, parts)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, starts), [len(keys)]])


def pack(numbers: np.ndarray) -> bytes:
    """Non-negative integers, byte plane by byte plane without the empty ones, compressed."""
    wide = len(numbers) and (int(numbers.max()).bit_length() + 7) // 8
    planes = np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T[:wide])
    return len(numbers).to_bytes(8, "little") + wide.to_bytes(1, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpack(blob: bytes) -> np.ndarray:
    n, wide = int.from_bytes(blob[:8], "little"), blob[8]
    planes = np.zeros((8, n), np.uint8)
    if n and wide:
        planes[:wide] = np.frombuffer(pa.decompress(blob[9:], n * wide, "zstd", asbytes=True), np.uint8).reshape(wide, n)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def _pack_keys(keys: np.ndarray, times: np.ndarray) -> bytes:
    head = pack(np.diff(keys, prepend=np.uint64(0)))
    return len(head).to_bytes(8, "little") + head + pack(times)


def _unpack_keys(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    return np.cumsum(unpack(blob[8 : 8 + n]), dtype=np.uint64), unpack(blob[8 + n :])


def _mark(keys: np.ndarray) -> int:
    return int(np.bitwise_xor.reduce(keys, initial=np.uint64(0)))


def _asked(parts: int, least: int):
    """Each distinct n-gram of a block, with its count in the training texts, in one row for each part of the keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, (block, (_, train)) in enumerate(blocks(batches, least)):
            train = train.to_numpy(zero_copy_only=False)
            for order in (1, 2, 3):
                keys = block.keys(order) << np.uint64(1) | block.of_text(order, train).astype(np.uint64)
                keys.sort()
                heads = _heads(keys >> np.uint64(1))
                times = np.add.reduceat(keys & np.uint64(1), heads) if len(heads) else keys
                keys = keys[heads] >> np.uint64(1)
                bounds = _bounds(keys, parts)
                full = np.flatnonzero(np.diff(bounds))
                own = [slice(bounds[p], bounds[p + 1]) for p in full]
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array(full, pa.int32()),
                        "task": pa.array([task] * len(full), pa.int32()),
                        "block": pa.array([number] * len(full), pa.int32()),
                        "ord": pa.array([order] * len(full), pa.int32()),
                        "mark": pa.array([_mark(keys[s]) for s in own], pa.int64()),
                        "blob": pa.array([_pack_keys(keys[s], times[s]) for s in own], pa.binary()),
                    }
                )

    return run


def _counted(asked: pa.Table) -> pa.Table:
    """The whole corpus' counts of what every block asks of one part, in the order of its keys; and tokens and distinct tokens, under task -1."""
    rows = asked.select(["task", "block", "ord", "mark", "blob"]).to_pylist()
    part = asked.column("part")[0].as_py()
    found, n, v = [], 0, 0
    for order in (1, 2, 3):
        own = [r for r in rows if r["ord"] == order]
        if not own:
            continue
        keys, times = zip(*(_unpack_keys(r["blob"]) for r in own))
        every, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, weights=np.concatenate(times), minlength=len(every)).astype(np.uint64)
        if order == 1:
            n, v = int(total.sum()), int((total > 0).sum())
        ends = np.cumsum([len(k) for k in keys])
        found += [r | {"blob": pack(total[place[b - len(k) : b]])} for r, k, b in zip(own, keys, ends)]
    found.append({"task": -1, "block": 0, "ord": 0, "mark": 0, "blob": b""})
    stats = [0] * (len(found) - 1)
    table = pa.Table.from_pylist(found, schema=pa.schema([("task", pa.int32()), ("block", pa.int32()), ("ord", pa.int32()), ("mark", pa.int64()), ("blob", pa.binary())]))
    return table.append_column("part", pa.array([part] * len(found), pa.int32())).append_column("n", pa.array([*stats, n])).append_column("v", pa.array([*stats, v]))


class Automaton:
    """What a block can reach of the backoff automaton, laid along its texts.

    States are the root, the last word, and the last two words read, where the
    training texts hold them. An arc reads a word at its smoothed log10
    probability; a state without an arc for a word fails, at a weight, to the
    state without its first word, and the root reads any word. After each token
    the traversal is in the longest state its text allows, so the counts of the
    n-grams that end at a token give its state, and a block's texts are all
    traversed in one pass over their array.

    `counts` has, for each order, the count of the n-gram at each of its places.
    """

    def __init__(self, block: Block, counts: list[np.ndarray], n: int, v: int, backoff: tuple[float, float] = BACKOFF):
        self._block, self._backoff = block, backoff
        self._counts = [np.zeros(len(block.flat)) for _ in counts]
        for order, (held, own) in enumerate(zip(self._counts, counts), 1):
            held[block.places(order)] = own
        self._counts[0][block.first] = self._counts[0][block.first + block.sizes]  # a text is begun as often as one is ended
        self._bottom = n + SMOOTH * (v + 1)

    def traverse(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: the log10 probability of its arcs and failures, that of the root alone, and its known tokens."""
        block, (one, *_) = self._block, self._counts
        root = np.log10((one + SMOOTH) / self._bottom)
        weight = root
        for order, give in enumerate(self._backoff, 2):
            at = block.places(order)
            times, state = self._counts[order - 1][at], self._counts[order - 2][at - 1]
            lower = weight[at]
            arc = np.log10((times + give * 10**lower) / (state + give))
            fail = np.log10(give / (state + give))
            weight = weight.copy()
            weight[at] = np.where(times > 0, arc, fail + lower)
        sums = lambda x: np.add.reduceat(x[block.read], np.cumsum(block.sizes) - block.sizes)
        return sums(weight), sums(root), sums((one > 0).astype(np.int64))


_SCORED = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _traversed(path: str, least: int, n: int, v: int, backoff: tuple[float, float]):
    """Score the blocks of a task with the counts that were written for it."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def replies(task: int) -> dict:
        store, folder = fs.FileSystem.from_uri(path)
        found = store.get_file_info(fs.FileSelector(f"{folder}/task={task}", allow_not_found=True))
        held: dict = {}
        for file in found:
            if file.path.endswith(".parquet"):
                for r in pq.read_table(store.open_input_file(file.path), columns=["block", "ord", "part", "mark", "blob"]).to_pylist():
                    held.setdefault((r["block"], r["ord"]), []).append((r["part"], r["mark"], r["blob"]))
        return held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for number, (block, (doc_ids, _)) in enumerate(blocks(batches, least)):
            held = replies(TaskContext.get().partitionId()) if held is None else held
            counts = []
            for order in (1, 2, 3):
                keys = block.keys(order)
                by_key = np.argsort(keys)
                heads = _heads(keys[by_key])
                own = sorted(held.pop((number, order), []))
                found = np.concatenate([np.zeros(0, np.uint64), *(unpack(blob) for _, _, blob in own)])
                if len(found) != len(heads) or _mark(keys[by_key[heads]]) != _mark(np.array([m for _, m, _ in own], np.uint64)):
                    raise RuntimeError(_CHANGED)
                counts.append(np.empty(len(keys)))
                counts[-1][by_key] = np.repeat(found.astype(float), np.diff(heads, append=len(keys)))
            own = Automaton(block, counts, n, v, backoff)
            del keys, by_key, heads, found, counts
            score, base, known = own.traverse()
            yield pa.RecordBatch.from_arrays([doc_ids.cast(pa.int64()), pa.array(block.sizes, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(score)], schema=schema)

    return run


def score(docs: DataFrame, train: str, settled: bool = False, backoff: tuple[float, float] = BACKOFF, block_tokens: int = BLOCK_TOKENS, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for every row of (doc_id, text), by a model of the rows where `train` holds.

    No n-gram is left out, however rare, and none is held by all workers: each
    block of texts asks for the distinct n-grams it holds, with its own counts;
    these are added up by parts of the key range; and the block gets back the
    counts of the whole corpus, from which it builds the automaton its texts can
    reach. So memory holds one block or one part, a frequent n-gram is one entry
    a block, and texts are never shuffled.

    The texts are read twice and must be the same in the same tasks; a checksum
    of each block's keys tells if they are not, as when executors were lost in
    between and files were cut in another way, and then all is done again. Other
    frames than plain reads of files (`settled`) are written to the shared folder
    first.

    Null and empty texts are one end token; null ids and repeated rows each
    return a row; extra columns are ignored; an empty table gives an empty
    result. Without training texts every token has the smoothed probability of a
    new one.
    """
    spark = session_of(docs)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.expr(train).alias("train") if isinstance(train, str) else train.alias("train"), clean_text().alias("text"))
    source = source if settled else staged(source, "texts")
    size = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, math.ceil(size / part_bytes))
    for turn in range(_RETRIES):
        path = f"{shared_dir(spark).rstrip('/')}/siftstone/ngrams-{uuid.uuid4().hex}"
        asked = source.mapInArrow(_asked(parts, block_tokens), _ASKED)
        counted = asked.groupBy("part").applyInArrow(_counted, "task int, block int, ord int, mark long, blob binary, part int, n long, v long")
        counted.repartition("task").sortWithinPartitions("task", "block").write.partitionBy("task").parquet(path)
        held = spark.read.schema("part int, n long, v long, task int").parquet(path)
        n, v = held.where("task = -1").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
        try:
            scored = staged(source.mapInArrow(_traversed(path, block_tokens, n, v, backoff), _SCORED), "scores")
        except PySparkException as error:
            if _CHANGED not in str(error) or turn + 1 == _RETRIES:
                raise
        else:
            return scored.select("doc_id", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
    raise AssertionError("unreachable")


def op8_backoff_automaton(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those whose crc32(doc_id as text) mod 10 is not 0."""
    scored = score(documents(spark, sf_dir), id_crc32() % 10 != 0, settled=True)
    return scored.select("doc_id", (id_crc32() % 10 == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
