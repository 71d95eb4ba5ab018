"""Quality classifier by positive-unlabelled learning.

The non-negative unbiased risk (Kiryo, Niu, du Plessis and Sugiyama, NeurIPS 2017) is minimised over trusted positives and
unlabelled web text: pi * R_p+ + max(0, R_u- - pi * R_p-), here for a linear model by Newton steps whose sums run over all
rows of a table of features. The class prior pi is estimated by best bin estimation (Garg et al., NeurIPS 2021) from histograms
of the scores of all positives and unlabelled rows of the half that did not fit them. No negative label is read, nothing is
sampled, and only sums come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fresh, let, map_arrow, quoted, small, table, words_of

#: Weight of the ridge.
L2 = 1e-3
FOLDS = 5
THRESHOLD = 0.3
FEATURES = ("symbols", "upper", "digits", "marks", "other", "mean_word", "long_word", "distinct", "adjacent", "lines", "dup_lines", "log_words")


def features(text: Column) -> Column:
    """array<double> of FEATURES of the whole text; a null text counts as empty. Rates are square roots, for small ones count."""
    among = lambda t, chars: F.length(F.regexp_replace(t, f"[^{chars}]+", ""))
    root = lambda a, b: F.sqrt(a / F.greatest(b, F.lit(1)))

    def by_words(w: Column, t: Column, chars: Column, lines: Column) -> Column:
        n = F.size(w)
        # Neighbours that are equal: the words against the words from the second on.
        pairs = F.zip_with(F.slice(w, 2, n), w, lambda x, y: F.coalesce(x == y, F.lit(False)))
        same = F.size(F.filter(pairs, lambda x: x))
        return F.array(
            root(among(t, r"#*$%&|<>@\^~=_{}\[\]\\"), chars), root(among(t, "A-Z"), chars), root(among(t, "0-9"), chars), root(among(t, "!?;:"), chars), root(among(t, r"\"'()\-/+"), chars),
            chars / F.greatest(n, F.lit(1)) / 10.0, root(F.size(F.filter(w, lambda x: F.length(x) > 20)), n), F.size(F.array_distinct(w)) / F.greatest(n, F.lit(1)), root(same, n),
            root(F.size(lines), n), root(F.size(lines) - F.size(F.array_distinct(lines)), F.size(lines)), F.log1p(n.cast("double")) / 5.0,
        )

    def of(t: Column) -> Column:
        chars = F.length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", ""))
        return let(words_of(t), lambda w: let(chars, lambda c: let(F.split(t, "\n"), lambda x: by_words(w, t, c, x))))

    return let(F.coalesce(text.cast("string"), F.lit("")), of)


@dataclass(frozen=True)
class Model:
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    bias: float
    prior: float

    def logit(self, x: Column) -> Column:
        z = F.lit(self.bias)
        for i, (m, s, w) in enumerate(zip(self.mean, self.scale, self.weights, strict=True)):
            z = z + (F.get(x, F.lit(i)) - m) * (w / s)
        return z

    def score(self, x: Column) -> Column:
        return 1.0 / (1.0 + F.exp(-self.logit(x)))


def _bias(n: int) -> Model:
    """What is known without positives or documents: nothing."""
    return Model((0.0,) * n, (1.0,) * n, (0.0,) * n, 0.0, 0.5)


COLUMNS = [f"x{i}" for i in range(len(FEATURES))]


def featurise(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x0, x1, ...) of every row of docs, written once: the texts are not read again."""
    x = docs.select(F.col(quoted(id_col)).alias("id"), features(F.col(quoted(text_col))).alias("x"))
    return scratch.table(x.select("id", *[F.get("x", F.lit(i)).alias(c) for i, c in enumerate(COLUMNS)]), "features")


def _sums(rows: DataFrame, numbers) -> dict[bool, np.ndarray]:
    """numbers(x) summed over all rows (pos, x0, x1, ...), for positives and unlabelled apart. Each task sums its rows; as many
    numbers as numbers() gives, twice, come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bool, np.ndarray] = {}
        for b in batches:
            pos = np.asarray(b.column(0).to_numpy(zero_copy_only=False), bool)
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns[1:]])
            for side in (False, True):
                if len(y := x[pos == side]):
                    total[side] = total.get(side, 0.0) + numbers(y)
        for side, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), side)), pa.array(np.arange(len(v))), pa.array(v)], names=["pos", "k", "v"])

    out = map_arrow(rows.select("pos", *COLUMNS), run, "pos boolean, k long, v double").groupBy("pos", "k").agg(F.sum("v").alias("v")).collect()
    got = {side: np.array([r["v"] for r in sorted(out, key=lambda r: r["k"]) if r["pos"] == side]) for side in (False, True)}
    return {side: v for side, v in got.items() if len(v)}


class Risk:
    """The non-negative risk of a linear model over tables of any size: each evaluation is one pass over the features."""

    def __init__(self, rows: DataFrame, mean: np.ndarray, scale: np.ndarray, l2: float):
        self.rows, self.mean, self.scale, self.l2 = rows, mean, scale, l2

    def at(self, w: np.ndarray, prior: float | None) -> tuple[tuple, tuple]:
        """(value, gradient, Hessian) at w of the positives' risk and the ridge, and of what max(0, .) is taken of: the risk of the
        negatives. Without a prior: of positives against unlabelled rows taken as negatives, each side weighing the same."""
        mean, scale, d = self.mean, self.scale, len(w)

        def numbers(x: np.ndarray) -> np.ndarray:
            x = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
            z = x @ w
            s = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            as_neg = np.logaddexp(0, z)  # loss if the label is taken as negative; the other one is this less z
            return np.concatenate([[len(x), z.sum(), as_neg.sum()], x.sum(0), s @ x, ((x * (s * (1 - s))[:, None]).T @ x).ravel()])

        sums = _sums(self.rows, numbers)
        p, u = (sums[side] / sums[side][0] for side in (True, False))
        part = lambda v: (v[1], v[2], v[3 : 3 + d], v[3 + d : 3 + 2 * d], v[3 + 2 * d :].reshape(d, d))
        (z_p, neg_p, x_p, sx_p, h_p), (_, neg_u, _, sx_u, h_u) = part(p), part(u)
        ridge = np.append(np.full(d - 1, self.l2), 0.0)
        a, b = (1.0, 0.0) if prior is None else (prior, prior)
        pos = a * (neg_p - z_p) + 0.5 * (ridge * w * w).sum(), a * (sx_p - x_p) + ridge * w, a * h_p + np.diag(ridge)
        return pos, (neg_u - b * neg_p, sx_u - b * sx_p, h_u - b * h_p)

    def minimise(self, prior: float | None, steps: int = 30, tolerance: float = 1e-6) -> np.ndarray:
        """The least of positives + max(0, negatives). That is the greatest over m in [0, 1] of positives + m * negatives, convex in
        the weights for each m: Newton steps with m = 1 while the negatives' risk is above 0, and where it would fall below, on
        weights and m together towards the point at which it is 0."""
        w, m = np.zeros(len(self.mean) + 1), 1.0
        best, least, last = w, np.inf, np.inf
        for _ in range(steps):
            (pv, pg, ph), (nv, ng, nh) = self.at(w, prior)
            value = pv + max(0.0, nv)
            if value < least:
                best, least = w, value
            h, g = ph + m * nh + 1e-9 * np.eye(len(w)), pg + m * ng
            if abs(last - value) < tolerance and (m == 1.0 or abs(nv) < tolerance):
                break
            last = value
            if nv < 0 or m < 1.0:
                kkt = np.block([[h, ng[:, None]], [ng[None, :], np.zeros((1, 1))]])
                step = np.linalg.lstsq(kkt, -np.append(pg, nv), rcond=None)[0]
                step, m = step[:-1], float(np.clip(step[-1], 0.0, 1.0))
            else:
                step = -np.linalg.lstsq(h, g, rcond=None)[0]
            longest = np.abs(step).max()
            w = w + step * min(1.0, 4.0 / max(longest, 1e-12))
        return best


#: Bins of a logit, in the histograms that the prior is read off.
BINS, BIN_LIMIT = 20, 40


def score_histogram(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Of all rows (pos, x0, ...), positives and unlabelled: counts by logit, in bins of 1 / BINS."""
    z = F.greatest(F.least(model.logit(F.array(*COLUMNS)), F.lit(float(BIN_LIMIT))), F.lit(float(-BIN_LIMIT)))
    out = np.zeros((2, 2 * BIN_LIMIT * BINS + 1))
    for r in rows.groupBy("pos", F.floor(z * BINS).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect():
        out[int(r["pos"]), r["bin"] + BIN_LIMIT * BINS] = r["n"]
    return out[1], out[0]


def estimate_prior(p: np.ndarray, u: np.ndarray, delta: float = 0.1) -> float:
    """Share of positives among the unlabelled: the least ratio, over thresholds, of their upper share to the positives', with
    confidence widths. p: histogram of the scores, by a classifier of positive against unlabelled, of positives that it was not
    fitted on; u: of the unlabelled."""
    if not p.sum() or not u.sum():
        return 0.5
    upper = lambda n: n[::-1].cumsum()[::-1] / n.sum()
    qp, qu = upper(p), upper(u)
    use = qp >= 0.01
    qp, qu = qp[use], qu[use]
    width = np.sqrt(np.log(4 / delta) / (2 * u.sum())) + np.sqrt(np.log(4 / delta) / (2 * p.sum()))
    best = int(np.argmin(qu / qp + width * (1 + qu / qp) / qp))
    return float(np.clip(qu[best] / qp[best], 0.05, 0.98))


def fold(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % FOLDS


def fit_rows(rows: DataFrame, l2: float = L2) -> Model:
    """rows (pos, half, x0, ...): the features of every trusted positive (pos) and of every unlabelled row. Half of the positives
    and of the unlabelled fit the classifier that the prior is estimated with, on the others; then all fit the model."""
    moments = _sums(rows, lambda x: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]))
    if len(moments) < 2:
        return _bias(len(FEATURES))
    k = len(FEATURES)
    n, s1, s2 = (lambda m: (m[0], m[1 : 1 + k], m[1 + k :]))(moments[False] + moments[True])
    mean = s1 / n
    scale = np.maximum(np.sqrt(np.maximum(s2 / n - mean * mean, 0)), 1e-3)

    def model(w: np.ndarray, prior: float) -> Model:
        # Rounded, so that the order in which tasks end does not show.
        r = lambda v: tuple(round(float(x), 9) for x in v)
        return Model(r(mean), r(scale), r(w[:-1]), r(w[-1:])[0], prior)

    first, rest = rows.where("half"), rows.where("not half")
    if len(_sums(first, lambda x: np.array([float(len(x))]))) < 2:
        first = rows
    against = Risk(first, mean, scale, l2).minimise(None)
    prior = round(estimate_prior(*score_histogram(rest, model(against, 0.5))), 9)
    return model(Risk(rows, mean, scale, l2).minimise(prior), prior)


def training_rows(table_: DataFrame, positives: DataFrame) -> DataFrame:
    """table_ (id, x0, ...) of all training rows and positives (id): (pos, half, x0, ...), with the rows of positives once as
    positives and all rows as unlabelled. Repeated positives count once; null ids are never positive."""
    half = (F.pmod(F.xxhash64("id"), F.lit(2)) == 0).alias("half")
    u = table_.select(F.lit(False).alias("pos"), half, *COLUMNS)
    ids = positives.where("id is not null").distinct()
    ids = F.broadcast(ids) if small(ids) else ids
    return u.unionByName(table_.join(ids, "id", "left_semi").select(F.lit(True).alias("pos"), half, *COLUMNS))


def fit(docs: DataFrame, positives: DataFrame, id_col: str = "doc_id", text_col: str = "text", l2: float = L2) -> Model:
    """positives: ids of trusted documents, column id_col. Every row of docs is unlabelled text, null and empty texts, null ids
    and repeated rows too; the rows of trusted ids are positives as well. Nothing is sampled: each step sums over all rows. Very
    long texts count as one row like others. Without positives or documents the model knows nothing."""
    scratch = Scratch(docs.sparkSession)
    x = featurise(docs, scratch, id_col, text_col)
    rows = scratch.table(training_rows(x, positives.select(F.col(quoted(id_col)).alias("id"))), "training")
    model = fit_rows(rows, l2)
    scratch.drop()
    return model


def classify(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with a struct column quality_score (underscored where taken): score, predicted. All other columns stay as they came,
    whatever their names. Null and empty texts are scored alike; repeated rows alike; an empty table gives no rows."""
    (name,) = fresh(docs, "quality_score")
    score = let(features(F.col(quoted(text_col))), model.score)
    s = let(score, lambda z: F.struct(z.alias("score"), (z >= threshold).cast("int").alias("predicted")))
    return docs.withColumn(name, s)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score by a model fitted on the folds that are not held out; features are computed once for both."""
    scratch = Scratch(spark)
    x = featurise(table(spark, sf_dir, "documents").select("doc_id", "text"), scratch)
    train = F.coalesce(fold(F.col("id")) != 0, F.lit(True))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality").where(train)
    good = labels.groupBy("id").agg(F.min("quality").alias("quality")).where("quality = 1").select("id")
    rows = scratch.table(training_rows(x.where(train), good), "training")
    model = fit_rows(rows)
    scratch.drop(x)
    score = model.score(F.array(*COLUMNS))
    out = x.select(F.col("id").alias("doc_id"), (~train).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
