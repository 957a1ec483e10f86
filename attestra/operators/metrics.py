"""Evaluation: classification, ordered selection, ranking, agreement, calibration and paired significance."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

EPS = 1e-12


def confusion(df: DataFrame, by: list[str], gold: str = "gold", pred: str = "pred") -> DataFrame:
    """``by, gold, pred, n``; rows without a gold label (below 0) are left out, predictions below 0 are parse errors."""
    return df.where(F.col(gold) >= 0).groupBy(*by, F.col(gold).alias("gold"), F.greatest(F.col(pred), F.lit(-1)).alias("pred")).agg(F.count("*").alias("n"))


def class_scores(conf: DataFrame, by: list[str], labels: DataFrame, eps: float = EPS) -> DataFrame:
    """Precision, recall and F1 of every declared label from a confusion table, absent ones included.

    With ``eps`` it stands in every denominator; with 0 a label without gold and predictions scores 0. ``labels``:
    ``by, label``. The table is as small as labels squared, whatever was counted.
    """
    gold = conf.groupBy(*by, F.col("gold").alias("label")).agg(F.sum("n").alias("ng"), F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"))
    pred = conf.groupBy(*by, F.col("pred").alias("label")).agg(F.sum("n").alias("np"))
    rows = labels.join(gold, [*by, "label"], "left").join(pred, [*by, "label"], "left").na.fill(0, ["ng", "np", "tp"])
    tp, np_, ng = F.col("tp"), F.col("np"), F.col("ng")
    if eps:
        p, r = tp / (np_ + eps), tp / (ng + eps)
        f1 = 2 * p * r / (p + r + eps)
    else:
        p, r = F.when(np_ > 0, tp / np_).otherwise(0.0), F.when(ng > 0, tp / ng).otherwise(0.0)
        f1 = F.when(np_ + ng > 0, 2 * tp / (np_ + ng)).otherwise(0.0)
    return rows.select(*by, "label", p.alias("precision"), r.alias("recall"), f1.alias("f1"), "ng")


def classification(df: DataFrame, by: list[str], labels: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Accuracy, macro scores over the declared labels, parse-error rate, and ordinal error over the valid predictions."""
    conf = confusion(df, by, gold, pred)
    macro = class_scores(conf, by, labels).groupBy(*by).agg(*(F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")), F.count("*").alias("labels"))
    n, valid, gap = F.col("n"), F.col("pred") >= 0, F.abs(F.col("pred") - F.col("gold"))
    rest = conf.groupBy(*by).agg(
        F.sum("n").alias("rows"),
        (F.sum(F.when(F.col("gold") == F.col("pred"), n).otherwise(0)) / F.sum("n")).alias("accuracy"),
        (F.sum(F.when(~valid, n).otherwise(0)) / F.sum("n")).alias("parse_errors"),
        (F.sum(F.when(valid, gap * n)) / F.sum(F.when(valid, n))).alias("mae"),
        (F.sum(F.when(valid & (gap >= 3), n).otherwise(0)) / F.sum(F.when(valid, n))).alias("extreme"),
    )
    return rest.join(macro, by).withColumn("mae_share", F.col("mae") / F.greatest(F.col("labels") - 1, F.lit(1)))


def ordered_selection(pairs: DataFrame, by: list[str], k: int) -> DataFrame:
    """Of each group's oracle and predicted orders: ``by, item, oracle, pred`` with ranks from 1, null where absent.

    recall, precision and Jaccard of the first k; whether the first item agrees; share of positions that agree; whether the
    first two agree; NDCG with gain 2 ** max(k - rank from 0, 1) - 1; and the share of pairs in the overlap in the same order.
    """
    o, p = F.col("oracle"), F.col("pred")
    rel = F.when(o <= k, F.greatest(k - (o - 1), F.lit(1))).otherwise(0)
    gain = F.pow(F.lit(2.0), rel) - 1
    base = pairs.where((o <= k) | (p <= k)).groupBy(*by).agg(
        F.count_if(o <= k).alias("no"),
        F.count_if(p <= k).alias("np"),
        F.count_if((o <= k) & (p <= k)).alias("both"),
        F.count_if((o == p) & (o <= k)).alias("same"),
        F.max(F.when((o == 1) & (p == 1), 1.0).otherwise(0.0)).alias("top1"),
        F.count_if((o == p) & (o <= 2)).alias("pre2"),
        F.sum(F.when(p <= k, gain / F.log2(p + 1)).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(o <= k, gain / F.log2(o + 1)).otherwise(0.0)).alias("idcg"),
    )
    near = pairs.where((o <= k) & (p <= k))
    x, y = near.alias("x"), near.alias("y")
    order = x.join(y, [F.col(f"x.{c}") == F.col(f"y.{c}") for c in by]).where("x.oracle < y.oracle")
    order = order.groupBy(*(F.col(f"x.{c}").alias(c) for c in by)).agg(F.count("*").alias("pairs"), F.avg(F.when(F.col("x.pred") < F.col("y.pred"), 1.0).otherwise(0.0)).alias("order_acc"))
    out = base.join(order, by, "left").na.fill(0, ["pairs", "order_acc"])
    return out.select(
        *by,
        (F.col("both") / F.greatest("no", F.lit(1))).alias("recall"),
        (F.col("both") / F.greatest("np", F.lit(1))).alias("precision"),
        (F.col("both") / (F.col("no") + F.col("np") - F.col("both"))).alias("jaccard"),
        "top1",
        (F.col("same") / F.greatest("no", F.lit(1))).alias("position_hits"),
        F.when((F.col("no") >= 2) & (F.col("np") >= 2) & (F.col("pre2") == 2), 1.0).otherwise(0.0).alias("prefix2"),
        F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"),
        "order_acc",
        "pairs",
    )


def roc_auc(df: DataFrame, by: list[str], score: str, positive: str) -> DataFrame:
    """``auc, average_precision`` by tie-averaged ranks from counts per distinct score, so no row is ranked on its own."""
    per = df.groupBy(*by, score).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("n"))
    low = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    high = Window.partitionBy(*by).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    below = per.withColumn("nb", F.coalesce(F.sum("n").over(low), F.lit(0))).withColumn("pc", F.sum("p").over(high)).withColumn("tc", F.sum(F.col("p") + F.col("n")).over(high))
    return below.groupBy(*by).agg(
        (F.sum(F.col("p") * (F.col("nb") + 0.5 * F.col("n"))) / F.nullif(F.sum("p") * F.sum("n"), F.lit(0))).alias("auc"),
        (F.sum(F.col("p") * F.col("pc") / F.col("tc")) / F.nullif(F.sum("p"), F.lit(0))).alias("average_precision"),
    )


def calibration(df: DataFrame, by: list[str], confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """Equal-width bins: ``bin, n, confidence, accuracy``."""
    b = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1)).cast("int").alias("bin")
    return df.groupBy(*by, b).agg(F.count("*").alias("n"), F.avg(confidence).alias("confidence"), F.avg(F.col(correct).cast("double")).alias("accuracy"))


def expected_calibration_error(bins: DataFrame, by: list[str]) -> DataFrame:
    return bins.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))) / F.sum("n")).alias("ece"))


def average_ranks(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Rank from 1 with ties averaged, from counts per distinct value."""
    per = df.groupBy(*by, value).agg(F.count("*").alias("__c"))
    below = per.withColumn("__b", F.coalesce(F.sum("__c").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return df.join(below.select(*by, value, (F.col("__b") + (F.col("__c") + 1) / 2).alias(name)), [*by, value])


def agreement(counts: DataFrame, by: list[str], categories: int) -> DataFrame:
    """Two raters' ``by, a, b, n`` with category numbers from 0: raw agreement, kappa, linearly weighted kappa and AC1.

    A measure is null where its chance-corrected denominator is 0.
    """
    tot = counts.groupBy(*by).agg(F.sum("n").alias("t"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"), F.sum(F.abs(F.col("a") - F.col("b")) * F.col("n")).alias("off"))
    pa = counts.groupBy(*by, F.col("a").alias("c")).agg(F.sum("n").alias("na"))
    pb = counts.groupBy(*by, F.col("b").alias("d")).agg(F.sum("n").alias("nb"))
    cross = pa.join(pb, by).groupBy(*by).agg(F.sum(F.when(F.col("c") == F.col("d"), F.col("na") * F.col("nb")).otherwise(0)).alias("pe"), F.sum(F.abs(F.col("c") - F.col("d")) * F.col("na") * F.col("nb")).alias("pw"))
    mean = counts.select(*by, F.explode(F.array("a", "b")).alias("c"), "n").groupBy(*by, "c").agg(F.sum("n").alias("m")).join(tot.select(*by, "t"), by)
    share = F.col("m") / (2 * F.col("t"))
    chance = mean.groupBy(*by).agg((F.sum(share * (1 - share)) / (categories - 1)).alias("ge"))
    rows = tot.join(cross, by).join(chance, by)
    t, po = F.col("t"), F.col("same") / F.col("t")
    pe = F.col("pe") / (t * t)
    return rows.select(
        *by,
        t.alias("n"),
        po.alias("agreement"),
        F.when(F.abs(1 - pe) > EPS, (po - pe) / (1 - pe)).alias("kappa"),
        F.when(F.col("pw") > 0, 1 - F.col("off") * t / F.col("pw")).alias("weighted_kappa"),
        F.when(F.abs(1 - F.col("ge")) > EPS, (po - F.col("ge")) / (1 - F.col("ge"))).alias("ac1"),
    )


def mcnemar(b: int, c: int) -> float:
    """Exact two-sided p of discordant counts b and c."""
    n = b + c
    if n == 0:
        return 1.0
    tail = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)) for i in range(min(b, c) + 1))
    return min(1.0, 2 * tail)


def mcnemar_column(b: Column, c: Column) -> Column:
    """The same in Spark, without leaving the JVM: the binomial tail summed by logarithms, so that no number of pairs underflows."""
    n, low = (b + c).cast("double"), F.least(b, c)
    first = -n * F.log(F.lit(2.0))
    step = F.struct(first.alias("total"), first.alias("term"))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i)
        top = F.greatest(acc["total"], term)
        return F.struct((top + F.log(F.exp(acc["total"] - top) + F.exp(term - top))).alias("total"), term.alias("term"))

    terms = F.when(low > 0, F.sequence(F.lit(1).cast("long"), low.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    tail = F.exp(F.aggregate(terms, step, add, lambda acc: acc["total"]))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def holm(df: DataFrame, by: list[str], p: str, tie: str, name: str = "adjusted") -> DataFrame:
    """Holm's step-down adjustment: running maximum of (m - i) p, at most 1."""
    order = Window.partitionBy(*by).orderBy(p, tie)
    ranked = df.withColumn("__i", F.row_number().over(order) - 1).withColumn("__m", F.count("*").over(Window.partitionBy(*by)))
    scaled = F.least(F.lit(1.0), (F.col("__m") - F.col("__i")) * F.col(p))
    return ranked.withColumn(name, F.max(scaled).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__i", "__m")


PRIME = (1 << 31) - 1


def _draw_sums(df: DataFrame, by: list[str], unit: str, value: str, draws: int, seed: int, weigh: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``by, draw, weight, total``: sums of each draw's weights and weighted values.

    A unit's number in a draw is ``hash(seed, unit) * hash(seed, draw)`` modulo a prime, the hashes being the first 32 bits of
    MD5. Each task adds up its rows for all draws at once, so a draw costs one row per group and task, and not one per row.
    """
    factor = np.array([int(hashlib.md5(f"{seed}|{k}".encode()).hexdigest()[:8], 16) % PRIME for k in range(1, draws + 1)], np.int64)
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col(unit).cast("string"))), 1, 8), 16, 10).cast("bigint") % PRIME
    rows = df.where(F.col(value).isNotNull() & F.col(unit).isNotNull()).select(*by, h.alias("__h"), F.col(value).cast("double").alias("__v"))
    out = StructType([*(rows.schema[c] for c in by), *StructType.fromDDL("draw int, weight double, total double").fields])
    arrow = to_arrow_schema(out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            first = pd.DataFrame({c: b.column(i).to_pandas() for i, c in enumerate(by)})
            code, keys = pd.factorize(first.apply(tuple, axis=1)) if len(by) != 1 else pd.factorize(first.iloc[:, 0], use_na_sentinel=False)
            at = pd.Series(np.arange(len(code))).groupby(code).first().to_numpy()
            n, h, v = len(keys), b.column(len(by)).to_numpy(), b.column(len(by) + 1).to_numpy()
            weight, total = np.zeros((draws, n)), np.zeros((draws, n))
            for k in range(draws):
                w = weigh(h * factor[k] % PRIME).astype(float)
                weight[k], total[k] = np.bincount(code, w, n), np.bincount(code, w * v, n)
            take = pa.array(np.tile(at, draws))
            cols = [b.column(i).take(take).cast(arrow.field(i).type) for i in range(len(by))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.repeat(np.arange(1, draws + 1), n), pa.int32()), pa.array(weight.ravel()), pa.array(total.ravel())], schema=arrow)

    return rows.mapInArrow(run, out).groupBy(*by, "draw").agg(F.sum("weight").alias("weight"), F.sum("total").alias("total"))


def poisson_limits(most: int = 8) -> list[int]:
    """A number below the k-th limit, and not below the one before, has Poisson weight k (mean 1)."""
    term = total = math.exp(-1)
    out = []
    for k in range(1, most + 1):
        out.append(int(total * PRIME))
        term /= k
        total += term
    return out


def bootstrap(df: DataFrame, by: list[str], unit: str, value: str, draws: int = 200, seed: int = 17, level: float = 0.95) -> DataFrame:
    """Poisson bootstrap of a mean: ``mean, low, high, se`` for each group; each unit has one weight in a draw, wherever its rows are."""
    limits = np.array(poisson_limits())
    sums = _draw_sums(df, by, unit, value, draws, seed, lambda x: np.searchsorted(limits, x, side="right"))
    means = sums.select(*by, (F.col("total") / F.nullif(F.col("weight"), F.lit(0.0))).alias("m"))
    lo = (1 - level) / 2
    point = df.groupBy(*by).agg(F.avg(value).alias("mean"))
    return point.join(means.groupBy(*by).agg(F.percentile("m", lo).alias("low"), F.percentile("m", 1 - lo).alias("high"), F.stddev_samp("m").alias("se")), by)


def permutation_test(df: DataFrame, by: list[str], unit: str, delta: str, draws: int = 200, seed: int = 23) -> DataFrame:
    """Paired sign-flip test of a mean difference: ``(1 + as extreme) / (1 + draws)``."""
    sums = _draw_sums(df, by, unit, delta, draws, seed, lambda x: 1 - 2 * (x % 2))
    seen = df.groupBy(*by).agg(F.sum(delta).alias("observed"), F.count(delta).alias("n"))
    extreme = F.count_if(F.abs("total") >= F.abs("observed") - EPS)
    return sums.join(seen, by).groupBy(*by).agg((F.first("observed") / F.first("n")).alias("mean"), ((1 + extreme) / (1 + draws)).alias("p"))


def dz(values: Sequence[float]) -> float:
    n = len(values)
    mean = sum(values) / n
    sd = math.sqrt(sum((v - mean) ** 2 for v in values) / (n - 1)) if n > 1 else 0.0
    return mean / sd if sd else 0.0
