"""Toxicity by a weighted finite-state pattern grammar over clauses."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftstone.llm.common import Memo, clean_text, documents, id_crc32, new_names, session_of, staged

#: Labelled rows at most that the lexicon and the scale are learned on.
FIT_ROWS = 20_000
#: A learned arc needs this share of toxic texts among all that hold it, and to be rarer by chance than once in so many lexicons.
PURITY, CHANCE = 0.9, 20
#: A learned stem needs several words, too.
STEM_WORDS, STEM_LENGTHS = 3, (4, 5, 6)
#: Toxic texts a seed word counts as having been seen in, before any label.
SEED_PRIOR = 2

#: Seed words, used where labels say nothing about a word. Matching is on lower-cased whole words.
INSULTS = "idiot idiots moron morons imbecile scum loser losers trash garbage vermin pathetic worthless disgusting stupid dumb clown filth filthy disgrace degenerate".split()
THREATS = "kill hurt destroy beat stab shoot strangle burn crush hunt murder".split()
TARGETS = "you your yours yourself u they them their he him his she her we us everyone".split()
NEGATIONS = "not no never without isn aren wasn don doesn didn cannot nobody hardly".split()
REPORTS = "said says say wrote writes claimed claims quoted quote alleged reported called asked told".split()

#: Words that build up to an insult: those that raise it, and the heads of "a piece of ...".
DEGREES = "such total complete absolute utter utterly totally completely really very so".split()
HEADS = "piece pieces bunch load sack waste bag".split()

_SEED_WEIGHT, _THREAT_WEIGHT = 3.0, 2.0
_TOKEN = re.compile(r"[^\W\d_]+|[.!?;:\n\"“”«»]")
_CLAUSE_END = frozenset(".!?;:\n")
_QUOTES = frozenset("\"“”«»")

# Symbols of the grammar's alphabet: what a word can be, and what transducers turn it into.
OTHER, INSULT, VERB, TARGET, NEGATION, REPORT, QUOTE, DEGREE, HEAD, THREAT, DENIED, SAID = range(12)
_CLOSE = 3


class Move(NamedTuple):
    """An arc: the next state, the symbol handed on, what it leaves of the weight so far, and what it adds."""

    state: int
    out: int
    factor: float = 1.0
    added: float = 0.0


@dataclass(frozen=True)
class Transducer:
    """A deterministic weighted transducer: arcs[state][symbol]; without an arc a symbol passes unchanged to the state in `passing`."""

    arcs: tuple[dict[int, Move], ...]
    passing: tuple[int, ...]

    def step(self, state: int, symbol: int) -> Move:
        return self.arcs[state].get(symbol) or Move(self.passing[state], symbol)


def _within(reach: int, trigger: int, at: Callable[[int], dict[int, Move]], keep: int) -> Transducer:
    """States 0 to `reach`: how many symbols after a trigger still count; `at` has the arcs while they do."""
    start = {trigger: Move(reach, keep)}
    return Transducer((start, *(at(k) | start for k in range(1, reach + 1))), tuple(max(0, k - 1) for k in range(reach + 1)))


def insult(raised: float = 0.5, reach: int = 2) -> Transducer:
    """Insults weigh more after a word of degree, and as the end of "a piece of ...", with gaps."""
    arcs = _within(reach, DEGREE, lambda k: {INSULT: Move(0, INSULT, 1.0, raised)}, DEGREE)
    heads = _within(reach, HEAD, lambda k: {INSULT: Move(0, INSULT, 1.0, 2 * raised)}, HEAD)
    # The two run side by side in one machine: the states after a head follow those after a degree.
    shift = lambda m: m._replace(state=m.state + reach if m.state else 0)
    both = [a | {HEAD: Move(2 * reach, HEAD)} for a in arcs.arcs]
    both += [{s: shift(m) for s, m in a.items()} | {DEGREE: Move(reach, DEGREE)} for a in heads.arcs[1:]]
    return Transducer(tuple(both), (*arcs.passing, *(p + reach if p else 0 for p in heads.passing[1:])))


def threat(weight: float = _THREAT_WEIGHT, reach: int = _CLOSE) -> Transducer:
    """A verb of harm becomes a threat when a target follows within `reach` words; alone it is any word."""
    arcs = _within(reach, VERB, lambda k: {TARGET: Move(0, THREAT, 1.0, weight)}, OTHER)
    return arcs


def negation(left: float = 0.4, reach: int = _CLOSE) -> Transducer:
    """An insult or threat within `reach` words after a negation is denied, and keeps that share of its weight."""
    # A verb of harm takes its words to reach its target, so a threat is denied from further off.
    denied = {s: left for s in (INSULT, THREAT)}
    return _within(reach + 1, NEGATION, lambda k: {s: Move(k - 1, DENIED, f) for s, f in denied.items()}, NEGATION)


def reported(left: float = 0.5) -> Transducer:
    """An insult or threat after a verb of reporting, or between quotation marks, is someone else's."""
    quiet = lambda k: {s: Move(k, SAID, left) for s in (INSULT, THREAT, DENIED)}
    arcs = ({REPORT: Move(1, REPORT), QUOTE: Move(2, QUOTE)}, quiet(1) | {QUOTE: Move(2, QUOTE)}, quiet(2) | {QUOTE: Move(0, QUOTE)})
    return Transducer(arcs, (0, 1, 2))


def target(bonus: float = 0.5) -> Transducer:
    """A clause that names a target and holds an insult of the speaker's own, in either order, weighs more, once; a threat has its target."""
    arcs = ({TARGET: Move(1, TARGET), INSULT: Move(2, INSULT), THREAT: Move(3, THREAT, 1.0, bonus)}, {s: Move(3, s, 1.0, bonus) for s in (INSULT, THREAT)}, {TARGET: Move(3, TARGET, 1.0, bonus), THREAT: Move(3, THREAT, 1.0, bonus)}, {})
    return Transducer(arcs, (0, 1, 2, 3))


#: The order of composition: what insults and threats are, whether they are denied, whether someone else's, and at whom.
PARTS = (insult, threat, negation, reported, target)


class Grammar:
    """The composition of transducers: each reads what the one before hands on. Built as states are met."""

    def __init__(self, *parts: Transducer):
        self._parts = parts
        self._names: dict[tuple[int, ...], int] = {(0,) * len(parts): 0}
        self._states: list[tuple[int, ...]] = [(0,) * len(parts)]
        self._arcs: dict[tuple[int, int], Move] = {}

    def step(self, state: int, symbol: int) -> Move:
        """The arc of the composed machine; its weight is `factor` times the word's own and what was added before, plus what is added after."""
        if (found := self._arcs.get((state, symbol))) is None:
            after, out, factor, added = [], symbol, 1.0, 0.0
            for part, own in zip(self._parts, self._states[state]):
                move = part.step(own, out)
                after.append(move.state)
                out, factor, added = move.out, factor * move.factor, added * move.factor + move.added
            name = self._names.setdefault(tuple(after), len(self._states))
            if name == len(self._states):
                self._states.append(tuple(after))
            found = self._arcs[state, symbol] = Move(name, out, factor, added)
        return found


@dataclass
class Model:
    """Arc weights of words and stems, and the logistic scale of the two clause features."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    scale: tuple[float, float, float] = (-2.5, 1.0, 0.5)


class Scorer:
    """Scores texts clause by clause; a worker keeps one for its model."""

    def __init__(self, model: Model, parts: Iterable[Callable[[], Transducer]] = PARTS):
        self._model, self._grammar = model, Grammar(*(part() for part in parts))
        self._symbol = Memo(self._classify)

    def _learned(self, word: str) -> float | None:
        if (w := self._model.words.get(word)) is None:
            w = max((self._model.stems[word[:n]] for n in STEM_LENGTHS if len(word) >= n and word[:n] in self._model.stems), default=None)
        return w

    def _classify(self, word: str) -> tuple[int, float]:
        """The symbol of a word and its own weight. Verbs of harm stay verbs whatever was learned, so they weigh only with a target."""
        if word in _QUOTES:
            return QUOTE, 0.0
        if word in _VERBS:
            return VERB, 0.0
        if (w := self._learned(word)) is not None:
            return (INSULT, w) if w > 0 else (OTHER, 0.0)
        for symbol, known in _CLASSES:
            if word in known:
                return symbol, _SEED_WEIGHT if symbol == INSULT else 0.0
        return OTHER, 0.0

    def clauses(self, text: str) -> list[float]:
        """Weights of the clauses that hold an insult or a threat."""
        tokens = _TOKEN.findall(text.lower())
        symbols = [(-1, 0.0) if t in _CLAUSE_END else self._symbol[t] for t in tokens]
        if not any(s == INSULT or s == VERB for s, _ in symbols):
            return []
        found, start = [], 0
        symbols.append((-1, 0.0))
        for end, (s, _) in enumerate(symbols):
            if s >= 0:
                continue
            clause, start = symbols[start:end], end + 1
            if any(x == INSULT or x == VERB for x, _ in clause):
                state, total = 0, 0.0
                for symbol, weight in clause:
                    state, out, factor, added = self._grammar.step(state, symbol)
                    if out in _HARM or added > 0:
                        total += weight * factor + added
                if total > 0:
                    found.append(total)
        return found

    def features(self, text: str) -> tuple[float, float]:
        """The heaviest clause and the log of their sum; zeros for a text without any."""
        found = self.clauses(text)
        return (max(found), math.log1p(sum(found))) if found else (0.0, 0.0)

    def score(self, text: str) -> float:
        a, b, c = self._model.scale
        x, y = self.features(text)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x + c * y))))


_VERBS, _HARM = frozenset(THREATS), frozenset((INSULT, THREAT, DENIED, SAID))
_CLASSES = tuple((symbol, frozenset(words)) for symbol, words in ((INSULT, INSULTS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (DEGREE, DEGREES), (HEAD, HEADS)))


def _log_odds(toxic: int, n: int, toxics: int, total: int) -> float:
    return math.log((toxic + 0.5) / (n - toxic + 0.5)) - math.log((toxics + 0.5) / (total - toxics + 0.5))


def _telling(counts: DataFrame, toxics: int, total: int) -> DataFrame:
    """Of (toxic, n) counts, those too one-sided for chance: the log-likelihood ratio pays for as many tests as there are rows."""
    if not 0 < toxics < total:
        return counts.limit(0)
    share, base = F.col("toxic") / F.col("n"), toxics / total
    gain = F.col("toxic") * F.ln(share / base) + F.when(F.col("toxic") < F.col("n"), (F.col("n") - F.col("toxic")) * F.ln((1 - share) / (1 - base))).otherwise(0.0)
    bar = math.log(CHANCE * max(1, counts.count()))
    return counts.where((F.col("toxic") > 0) & (share >= PURITY)).where(gain >= bar)


def fit_scale(rows: Iterable[tuple[float, float, int]]) -> tuple[float, float, float]:
    """Logistic regression of the label on the two clause features, by Newton steps with a ridge."""
    data = np.array(list(rows), dtype=float).reshape(-1, 3)
    y = data[:, 2]
    if not len(y) or y.min() == y.max():
        return Model().scale
    x = np.column_stack([np.ones(len(y)), data[:, :2]])
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = np.array([1e-3, 0.05, 0.05])
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Learn insult arcs and the scale from labelled rows (doc_id, toxic).

    The sample holds at most `rows` labelled documents, chosen by the hash of
    the id, so everything gathered here is bounded: it is joined to the texts
    by broadcast, word counts are made by Spark, and only the arcs that pass
    and two features a sampled text reach the driver. Equal texts count once.
    Without labels the seed words and the default scale remain.
    """
    session_of(docs)
    sample = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", clean_text().alias("text")).join(F.broadcast(sample), "doc_id").groupBy(F.sha2("text", 256).alias("key")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    texts = staged(texts.select("text", "toxic"), "toxic")
    total, toxics = texts.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    words = texts.select("toxic", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))).alias("word"))
    counts = words.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n"))
    good = _telling(counts, toxics, total).collect()
    seeds = counts.where(F.col("word").isin(INSULTS + THREATS)).collect()
    model = Model(words={r["word"]: _log_odds(r["toxic"] + SEED_PRIOR, r["n"] + SEED_PRIOR, toxics, total) for r in seeds})
    model.words |= {r["word"]: _log_odds(r["toxic"], r["n"], toxics, total) for r in good}
    stems = counts.select("word", "toxic", "n", F.explode(F.array(*(F.substring("word", 1, n) for n in STEM_LENGTHS))).alias("stem"))
    stems = stems.where("length(word) > length(stem)").groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"), F.count("*").alias("words"))
    stems = _telling(stems, toxics, total).where(F.col("words") >= STEM_WORDS).collect()
    model.stems = {r["stem"]: _log_odds(r["toxic"], r["n"], toxics, total) for r in stems}
    learned = texts.mapInArrow(_features_of(model), "x double, y double, toxic int").collect()
    model.scale = fit_scale((r["x"], r["y"], r["toxic"]) for r in learned)
    return model


def _features_of(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(model)
        for batch in batches:
            found = [own.features(t or "") for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.float64()), pa.array([y for _, y in found], pa.float64()), batch.column(1)], names=["x", "y", "toxic"])

    return run


def with_scores(docs: DataFrame, model: Model, name: str = "toxicity") -> DataFrame:
    """The rows of a frame with the toxicity of their whole texts, in one pass without a shuffle.

    Null and empty texts match no clause and get the score of a clean text.
    Null ids and repeated rows each return a row, extra columns are passed on;
    a column that already has the name is replaced.
    """
    session_of(docs)
    rest = docs.drop(name)
    at = rest.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(model)
        for batch in batches:
            scores = pa.array([own.score(t or "") for t in batch.column(at).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, name])

    return rest.mapInArrow(run, T.StructType([*rest.schema, T.StructField(name, T.DoubleType())]))


def clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of a frame whose texts score below the threshold; columns may have any name."""
    (name,) = new_names(docs, "toxicity")
    return with_scores(docs, model, name).where(F.col(name) < threshold).drop(name)


def training_labels(labels: DataFrame) -> DataFrame:
    """Labels whose crc32(doc_id as text) mod 5 is not 0."""
    return labels.where(id_crc32() % 5 != 0).select("doc_id", "toxic")


def op1_toxic_clauses(spark, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, learned without the held-out fifth."""
    docs = documents(spark, sf_dir)
    model = fit(docs, training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    scored = with_scores(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, "score")
    return scored.select("doc_id", (id_crc32() % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
