"""Intervals and paired tests as column expressions, and seeded resampling."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftstone.sources.tables import written

#: Words that the generator gives at a time; values of a block, blocks that every task may hold; places of a part, tasks that make draws.
WORDS = 1 << 16
PACK, HELD_BLOCKS = 1 << 16, 128
PLACES, MOST_TASKS = 1024, 1024


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def wilson(k: str | Column, n: str | Column, z: float = 1.96) -> Column:
    """struct(lo, hi): Wilson score interval of k successes in n, within [0, 1]; (0, 0) for n = 0."""
    k, n = _c(k).cast("double"), _c(n).cast("double")
    p, zz = k / n, z * z
    middle, spread = p + zz / (2 * n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))
    lo, hi = (middle - spread) / (1 + zz / n), (middle + spread) / (1 + zz / n)
    zero = F.lit(0.0)
    return F.struct(F.when(n > 0, F.greatest(zero, lo)).otherwise(zero).alias("lo"), F.when(n > 0, F.least(F.lit(1.0), hi)).otherwise(zero).alias("hi"))


def mcnemar_exact(b: str | Column, c: str | Column) -> Column:
    """Two-sided exact p of b against c discordant pairs; 1 for none, never over 1.

    The tail is summed by the ratio of neighbouring binomial terms, in logs, so
    it does not underflow for thousands of pairs.
    """
    b, c = _c(b).cast("int"), _c(c).cast("int")
    n, least = b + c, F.least(b, c)
    start = F.struct((-n * F.lit(0.6931471805599453)).alias("log"), F.lit(0.0).alias("sum"))
    step = lambda a, i: F.struct((a["log"] + F.ln((n - i).cast("double")) - F.ln((i + 1).cast("double"))).alias("log"), (a["sum"] + F.exp(a["log"])).alias("sum"))
    tail = F.aggregate(F.sequence(F.lit(0), least), start, step, lambda a: a["sum"])
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))


def nearest_rank(values: str | Column, share: float) -> Column:
    """The value at index min(n - 1, int(share * n)) of the sorted values of a group."""
    ordered = F.sort_array(F.collect_list(_c(values)))
    return F.element_at(ordered, F.least(F.size(ordered), F.floor(F.size(ordered) * F.lit(share)).cast("int") + 1))


def _uniform(n: int, seed: int) -> Iterator[np.ndarray]:
    """What random.Random(seed).randrange(n) gives, for n up to 2**32, some thousands at a time.

    Python takes the upper bits of the generator's 32-bit words, as many as n
    has, and passes over values that aren't below n.
    """
    words = random.Random(seed).getstate()[1]
    source = np.random.MT19937()
    source.state = {"bit_generator": "MT19937", "state": {"key": np.array(words[:-1], np.uint32), "pos": words[-1]}}
    while True:
        drawn = source.random_raw(WORDS) >> np.uint64(32 - n.bit_length())
        yield drawn[drawn < n].astype(np.int64)


def _sum(values: np.ndarray) -> float:
    """As Python adds them up in this order; integers are exact in any."""
    return int(values.sum(dtype=np.int64)) if values.dtype.kind in "bi" and values.dtype.itemsize <= 4 else sum(values.tolist())


def resampled_means(values: pd.Series, draws: int, seed: int) -> list[float]:
    """The means of `draws` samples of as many values, by the standard generator of Python; integers of 32 bits are added up as arrays."""
    own, n, out = values.to_numpy(), len(values), []
    source, ready = _uniform(n, seed), np.empty(0, np.int64)
    for _ in range(draws):
        parts, missing = [], n
        while missing:
            if not len(ready):
                ready = next(source)
            parts.append(own[ready[:missing]])
            ready = ready[missing:]
            missing -= len(parts[-1])
        out.append(_sum(np.concatenate(parts)) / n)
    return out


def bootstrap_exact(rows: DataFrame, group: str, order: str, value: str, draws: int = 10_000, seed: int = 0) -> DataFrame:
    """(group, lo, hi): percentile interval of the mean, with the standard generator of Python seeded for each group.

    For groups that fit a task, as an evaluation set does; `bootstrap_hashed` has no such bound.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        means = sorted(resampled_means(frame.sort_values(order)[value], draws, seed))
        return pd.DataFrame({group: [frame[group].iloc[0]], "lo": [means[int(0.025 * draws)]], "hi": [means[int(0.975 * draws) - 1]]})

    return rows.select(group, order, value).groupBy(group).applyInPandas(run, f"{group} string, lo double, hi double")


def paired_bootstrap_delta(rows: DataFrame, group: str, order: str, a: str, b: str, draws: int = 10_000, seed: int = 0) -> DataFrame:
    """(group, delta, lo, hi): mean of b - a over the same rows, with its percentile interval."""
    diffs = rows.withColumn("diff", F.col(b) - F.col(a))
    means = diffs.groupBy(group).agg(F.avg("diff").alias("delta"))
    return means.join(bootstrap_exact(diffs, group, order, "diff", draws, seed), group)


def ranked_values(rows: DataFrame, value: str, places: dict[str, Callable[[Column], Column]], *by: str) -> DataFrame:
    """(by..., name...): the value at a 0-based place of each group's sorted values, as a function of the group's size.

    Values are counted first, so what is ordered is one row for each distinct
    value, and no group is gathered.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("times"))
    order = Window.partitionBy(*by).orderBy(value)
    upto = counts.withColumns({"upto": F.sum("times").over(order), "size": F.sum("times").over(Window.partitionBy(*by))})
    at = lambda place: F.min(F.when(F.col("upto") > place(F.col("size")), F.col(value)))
    return upto.groupBy(*by).agg(F.max("size").alias("n"), *(at(place).alias(name) for name, place in places.items()))


def nearest(share: float) -> Callable[[Column], Column]:
    """The place min(n - 1, int(share * n)) of n values."""
    return lambda n: F.least(n - 1, F.floor(n * F.lit(share)))


def _bits(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def bootstrap_hashed(rows: DataFrame, group: str, value: str, order: str, draws: int = 200) -> DataFrame:
    """(group, lo, hi): the same interval with draws made by md5, so any engine can repeat it.

    Positions are numbered within the group; draw d takes at place i the value
    at md5(group|d|i) mod n. Places need only the size of a group, so they are
    made in even parts by all tasks; values are packed in blocks and, unless
    there are too many, held by every task. What is shuffled of the draws is
    sums and counts.
    """
    numbered = rows.select(group, F.col(value).cast("double").alias("x"), (F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1).cast("long").alias("i"))
    packed = numbered.groupBy(group, F.expr(f"i div {PACK}").alias("block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.struct("x").alias("v")))), lambda r: r["v"]["x"]).alias("values"))
    blocks = written(packed, "values")
    sizes = rows.groupBy(group).agg(F.count("*").alias("n"))
    parts = sizes.select(group, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(PLACES).cast("long"))).alias("at"))
    even = parts.repartition(max(1, min(MOST_TASKS, parts.count())))
    places = even.select(group, "n", F.explode(F.sequence("at", F.least(F.col("at") + PLACES, "n") - 1)).alias("i")).select(group, "n", "i", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("d"))
    picks = places.select(group, "d", F.pmod(_bits(F.concat_ws("|", group, "d", "i")), F.col("n")).alias("j")).select(group, "d", F.expr(f"j div {PACK}").alias("block"), (F.col("j") % PACK).cast("int").alias("k"))
    held = F.broadcast(blocks) if blocks.count() <= HELD_BLOCKS else blocks
    drawn = picks.join(held, [group, "block"]).select(group, "d", F.get("values", F.col("k")).alias("x"))
    means = drawn.groupBy(group, "d").agg(F.round(F.avg("x"), 9).alias("m"))
    ranked = means.select(group, "m", F.row_number().over(Window.partitionBy(group).orderBy("m", "d")).alias("r"))
    return ranked.groupBy(group).agg(F.max(F.when(F.col("r") == int(0.025 * draws) + 1, F.col("m"))).alias("lo"), F.max(F.when(F.col("r") == int(0.975 * draws), F.col("m"))).alias("hi"))
