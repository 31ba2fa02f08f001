"""A quality classifier by Bradley-Terry ranking of documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = 26


def features(text: str | None) -> np.ndarray:
    """What a reader sees of a whole text at a glance: shares of kinds of bytes, word shapes, repetition, length.

    Works on the UTF-8 bytes by counting, so a long text costs no more per byte than a short one.
    """
    out = np.zeros(FEATURES)
    data = np.frombuffer((text or "").encode(), np.uint8)
    n = data.size
    if n == 0:
        return out
    counts = np.bincount(data, minlength=256)
    lower, upper, digit = counts[97:123].sum(), counts[65:91].sum(), counts[48:58].sum()
    high = counts[128:].sum()
    white = counts[32] + counts[9:14].sum()
    marks = n - lower - upper - digit - high - white
    out[:5] = lower / n, upper / n, digit / n, high / n, marks / n
    out[5:16] = [counts[ord(c)] / n for c in "!|*#$%&.,\n@"]
    shares = counts[counts > 0] / n
    out[16] = -(shares * np.log(shares)).sum()
    out[17] = (data[1:] == data[:-1]).mean() if n > 1 else 0
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edges = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).view(np.int8)))
    begin, end = edges[::2], edges[1::2]
    if begin.size:
        size = (end - begin).astype(float)
        head, last = data[begin], data[end - 1]
        out[18], out[19] = size.mean() / 10, size.std() / 10
        out[20] = ((head >= 65) & (head <= 90) & (size > 1) & (data[np.minimum(begin + 1, n - 1)] >= 65) & (data[np.minimum(begin + 1, n - 1)] <= 90)).mean()
        out[21] = (~((last >= 97) & (last <= 122)) & (last < 128)).mean()
        sums = np.concatenate(([0], np.cumsum(data, dtype=np.int64)))
        sign = (sums[end] - sums[begin]) * 1009 + (end - begin) * 31 + head.astype(np.int64) * 7 + last
        out[22] = (sign[1:] == sign[:-1]).mean() if sign.size > 1 else 0
        out[23] = np.unique(sign).size / sign.size
        out[24] = min(1.0, np.log1p(begin.size) / 10)
    out[25] = min(1.0, np.log1p(n) / 16)
    return out


def feature_rows(docs: DataFrame, carry: str = "doc_id long") -> DataFrame:
    """The carried column, and f: array<double>, of each whole text."""
    name = carry.split()[0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({name: batch[name], "f": [features(t) for t in batch["text"]]})

    return docs.select(name, "text").mapInPandas(run, f"{carry}, f array<double>")


@dataclass(frozen=True)
class Ranker:
    """score = sigmoid(slope * (w . z - cut) + logit(threshold)), z the standardised features and their squares."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    cut: float
    slope: float
    threshold: float

    def raw(self, f: np.ndarray) -> np.ndarray:
        z = np.clip((f - self.mean) / self.scale, -6, 6)
        return np.hstack([z, z * z]) @ self.w

    def score(self, f: np.ndarray) -> np.ndarray:
        at = np.log(self.threshold / (1 - self.threshold))
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.raw(f) - self.cut) + at, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, pairs_each: int = 20, rounds: int = 400, threshold: float = 0.7, seed: int = 7) -> Ranker:
    """Learn a Ranker from `labels` (doc_id, quality).

    Pairs of a document marked 1 and one marked 0 state preferences; Bradley-Terry gives the first the better place
    with probability sigmoid(score difference), so the weights minimise the logistic loss on feature differences.
    `max_rows` labelled rows at most are used: those of the least CRC-32 of their id, a fixed sample. From them,
    `pairs_each` times as many pairs as the commoner kind has rows are drawn, 400,000 at most. The cut is the quantile
    of the training scores at the share of documents marked 0: the middle of the two scores that meet there.

    Labels that are null, or of ids that `docs` lacks, teach nothing; an id labelled twice counts twice. With only
    one kind of label, or none, there are no pairs: weights are 0 and every text scores 1 (or 0 if all are marked 0).
    """
    marked = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("q")).where("q in (0, 1) and _id is not null")
    marked = marked.orderBy(F.crc32(F.col("_id").cast("string")), "_id", "q").limit(max_rows)
    rows = docs.join(marked.hint("merge"), docs["doc_id"] == marked["_id"]).select(marked["q"], docs["text"].alias("text"))
    got = feature_rows(rows, "q int").toPandas()
    f, q = np.array(got["f"].tolist(), float).reshape(-1, FEATURES), got["q"].to_numpy(int)
    mean, scale = (f.mean(0), f.std(0) + 1e-3) if len(f) else (np.zeros(FEATURES), np.ones(FEATURES))
    none = Ranker(mean, scale, np.zeros(2 * FEATURES), -1.0 if not len(q) or q.max() else 1.0, 30.0, threshold)
    good, bad = np.flatnonzero(q == 1), np.flatnonzero(q == 0)
    if not good.size or not bad.size:
        return none
    order = np.lexsort((*f.T, q))  # pairs don't depend on the order in which rows arrive
    f, q = f[order], q[order]
    good, bad = np.flatnonzero(q == 1), np.flatnonzero(q == 0)
    rng = np.random.default_rng(seed)
    m = min(400_000, pairs_each * max(good.size, bad.size))
    z = np.clip((f - mean) / scale, -6, 6)
    z = np.hstack([z, z * z])
    a, b = rng.choice(good, m), rng.choice(bad, m)
    w = np.zeros(z.shape[1])
    step, m1, m2 = 0.05, np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        part = rng.integers(0, m, 4096)
        d = z[a[part]] - z[b[part]]  # of all pairs at once these would take hundreds of megabytes of the driver
        grad = -(d * (1 / (1 + np.exp(np.clip(d @ w, -30, 30))))[:, None]).mean(0) + 1e-4 * w
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad * grad
        w -= step * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
    raw = z @ w
    ranked = np.sort(raw)
    k = bad.size
    cut = float((ranked[k - 1] + ranked[min(k, ranked.size - 1)]) / 2)
    return Ranker(mean, scale, w, cut, 1.0, threshold)


def score(docs: DataFrame, model: Ranker, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Score every whole text: the `carry` columns, score (0 to 1), predicted (1 if score >= the model's threshold).

    The null text is scored as the empty one; repeated rows score alike; nothing but the text is looked at, so other
    columns don't matter. An empty table gives no rows. The model, a few hundred numbers, goes with the tasks.
    """

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([features(t) for t in texts]).reshape(-1, FEATURES)))

    # a column whose value a filter needs would be computed twice, were the function not declared to vary
    out = docs.select(*carry, scores.asNondeterministic()(F.coalesce("text", F.lit(""))).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= model.threshold).cast("int"))
