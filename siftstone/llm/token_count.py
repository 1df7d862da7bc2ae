"""Token counts by count-only Viterbi over a unigram vocabulary."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm.common import Memo, clean_text, documents, session_of

#: The mark that stands for a space in a piece.
MARK = "▁"
#: What an unknown character costs below the worst piece.
UNKNOWN = 10.0
_RUN = re.compile("▁+[^▁]*|[^▁]+")


class Counter:
    """Counts the pieces of the best segmentation of a text.

    The tokenizer's rules: a space becomes the mark, and one mark is put before
    the text; the best path has the highest sum of scores, and of equal paths to
    a place the one whose last piece begins first (the longest) stays; a
    character that no piece covers alone costs the worst score less ten, and
    counts as its UTF-8 bytes where the vocabulary has byte pieces, otherwise
    one for each run of such characters.
    """

    def __init__(self, pieces: list[tuple[str, float]], byte_pieces: bool, prefix: bool = True):
        import ahocorasick

        self._automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self._automaton.add_word(piece, (len(piece), score))
        if pieces:
            self._automaton.make_automaton()
        self._empty, self._prefix, self._bytes = not pieces, prefix, byte_pieces
        self._unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN
        # Where no piece holds a mark after another character, a run of marks begins a part that can be counted alone.
        self._whole = any(MARK in p.lstrip(MARK) for p, _ in pieces)
        self._memo = Memo(self.best)

    def best(self, part: str) -> tuple[int, bool, bool]:
        """Pieces of the best path through a part, and whether it begins and ends with an unknown character."""
        n = len(part)
        score, count = [0.0] + [None] * n, [0] * (n + 1)
        starts, ends = [False] * (n + 1), [False] * (n + 1)
        found: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        if not self._empty:
            for last, (size, s) in self._automaton.iter(part):
                found[last + 1].append((size, s))
        for end in range(1, n + 1):
            single = False
            for size, s in sorted(found[end], reverse=True):
                at = end - size
                single |= size == 1
                if score[end] is None or score[at] + s > score[end]:
                    score[end], count[end] = score[at] + s, count[at] + 1
                    starts[end], ends[end] = starts[at], False
            if not single and (score[end] is None or score[end - 1] + self._unknown > score[end]):
                at = end - 1
                score[end] = score[at] + self._unknown
                count[end] = count[at] + (len(part[at].encode()) if self._bytes else 0 if ends[at] else 1)
                starts[end], ends[end] = starts[at] or at == 0, True
        return count[n], starts[n], ends[n]

    def count(self, text: str) -> int:
        if not text:
            return 0
        marked = (MARK if self._prefix else "") + text.replace(" ", MARK)
        if self._whole:
            return self.best(marked)[0]
        total, open_run = 0, False
        for n, first, last in map(self._memo.__getitem__, _RUN.findall(marked)):
            total += n - (1 if open_run and first and not self._bytes else 0)
            open_run = last
        return total


def vocabulary(path: str) -> tuple[list[tuple[str, float]], bool]:
    """The scored pieces of a model file, and whether it has byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    return [(model.id_to_piece(i), model.get_score(i)) for i in plain], any(model.is_byte(i) for i in range(model.get_piece_size()))


@lru_cache(2)
def _counter(path: str) -> Counter:
    return Counter(*vocabulary(path))


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens) of every whole text of (doc_id, text), in one pass without a shuffle.

    Only counts are kept: no ids or pieces are made. Parts that repeat are
    counted once by a worker, whose memory of them is bounded. Null and empty
    texts have none; null ids and repeated rows each return a row; extra columns
    are ignored.
    """
    session_of(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _counter(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.count(t) for t in batch.column(1).to_pylist()], pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), clean_text().alias("text")).mapInArrow(run, "doc_id long, n_tokens long")


def op2_viterbi_counts(spark, sf_dir: str) -> DataFrame:
    """Unigram piece counts of all documents."""
    import public_tokenizers

    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
