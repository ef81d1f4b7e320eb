"""Operator 9: toxicity by a classifier chain.

The categories are predicted one after the other by linear models over hashed words; each model also takes the
probabilities of the categories before it. In training these come out of fold: a document's earlier
probabilities stem from models that have not seen it, so later models meet the same kind of input as in
prediction. Categories are 0/1 columns of the label table, in chain order. Word features are weighted by how far
their frequency differs between the classes (a smoothed log ratio, learned on the training folds only).

At most ``sample`` labelled documents are drawn (all classes of the last category alike, lowest hash of the id
first); each comes to the driver as at most ``buckets`` distinct numbers. Prediction is map-only over whole
texts.

Null and empty texts have no words: probabilities 0, not flagged. Rows are judged one by one; ties, repeated rows
and further columns have no effect. Label rows with a null are not used; if a document has several others, it is in a
category that any of them names. Without labels of both classes a category's probability is 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import joinable, python_task, release, small_batches, word_hashes, written

#: Bytes outside letters become spaces, A-Z lower case; lower() has already handled the rest.
LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def word_buckets(text: str | None, buckets: int) -> np.ndarray:
    """Distinct buckets of a whole text's words, sorted."""
    if not text:
        return np.empty(0, np.int64)
    words = set(text.lower().encode("utf-8", "surrogatepass").translate(LETTERS).split())
    return np.unique((word_hashes(list(words)) & np.uint64(buckets - 1)).astype(np.int64))


class Linear:
    """logit = bias + mean-free sum of word weights + weights of the earlier probabilities."""

    def __init__(self, words: np.ndarray, chain: np.ndarray, bias: float):
        self.words, self.chain, self.bias = words, chain, bias

    def probability(self, at: np.ndarray, earlier: list[float]) -> float:
        z = self.bias + float(self.words[at].sum()) + float(np.dot(self.chain, earlier))
        return float(1 / (1 + np.exp(-max(-60.0, min(60.0, z)))))


def _fit(rows: list[np.ndarray], earlier: np.ndarray, y: np.ndarray, buckets: int, least_seen: int = 3, epochs: int = 12, batch: int = 16, seed: int = 3) -> Linear:
    """Logistic regression by stochastic gradient descent in small batches, on the log-ratio scaled presence of words."""
    k = earlier.shape[1]
    if len(set(y.tolist())) < 2:
        return Linear(np.zeros(buckets, np.float32), np.zeros(k), -60.0 if not len(y) or y[0] == 0 else 60.0)
    seen = [np.zeros(buckets), np.zeros(buckets)]
    for at, label in zip(rows, y):
        seen[label][at] += 1
    n = [max(1, int((y == c).sum())) for c in (0, 1)]
    ratio = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    ratio[(seen[0] + seen[1]) < least_seen] = 0
    ratio = np.clip(ratio, -8, 8)
    # words that tell the classes apart no better than chance are left out
    spread = np.sqrt(1 / (seen[0] + 0.5) + 1 / (seen[1] + 0.5))
    ratio[np.abs(ratio) < 2.5 * spread] = 0
    kept = np.flatnonzero(ratio)
    number = np.full(buckets, -1)
    number[kept] = np.arange(len(kept))
    used = [number[at[ratio[at] != 0]] for at in rows]
    size = np.fromiter(map(len, used), np.int64, len(used))
    words, begin, scale = np.concatenate([*used, np.empty(0, np.int64)]), np.cumsum(size) - size, ratio[kept]
    rng = np.random.default_rng(seed)
    w, c, bias = np.zeros(len(kept)), np.zeros(k), float(np.log(n[1] / n[0]))
    step, steps = 0, epochs * len(rows)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            i = order[at : at + batch]
            rate, step = 0.05 * (1 - step / steps) + 1e-4, step + len(i)
            here = words[places(begin[i], size[i])]
            row = np.repeat(np.arange(len(i)), size[i])
            z = bias + np.bincount(row, weights=(w * scale)[here], minlength=len(i)) + earlier[i] @ c
            error = 1 / (1 + np.exp(-np.clip(z, -60, 60))) - y[i]
            slope = np.bincount(here, weights=error[row], minlength=len(kept)) * scale + 1e-4 * np.bincount(here, minlength=len(kept)) * w
            w -= rate * slope
            c -= rate * (error @ earlier[i])
            bias -= rate * error.sum()
    weights = np.zeros(buckets, np.float32)
    weights[kept] = w * scale
    return Linear(weights, c, bias)


def places(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of each stretch, one stretch after the other."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class Chain:
    def __init__(self, categories: list[str], models: list[Linear], threshold: float, buckets: int):
        self.categories, self.models, self.threshold, self.buckets = categories, models, threshold, buckets

    def probabilities(self, text: str | None) -> list[float]:
        at = word_buckets(text, self.buckets)
        out: list[float] = []
        for model in self.models:
            out.append(model.probability(at, out) if len(at) else 0.0)
        return out


def train(rows: list[np.ndarray], labels: np.ndarray, categories: list[str], buckets: int, folds: int = 5) -> Chain:
    """labels: rows x categories. Out-of-fold probabilities feed the later models and set the last one's threshold."""
    out = np.zeros((len(rows), len(categories)))
    models = []
    fold = np.arange(len(rows)) % folds
    for k in range(len(categories)):
        y = labels[:, k]
        for f in range(folds):
            inside, outside = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            model = _fit([rows[i] for i in inside], out[inside, :k], y[inside], buckets)
            out[outside, k] = [model.probability(rows[i], out[i, :k].tolist()) for i in outside]
        models.append(_fit(rows, out[:, :k], y, buckets))
    return Chain(categories, models, best_threshold(out[:, -1], labels[:, -1]) if len(rows) else 0.5, buckets)


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The middle of the range of thresholds with the best F1."""
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    if not y.any():
        return 0.5
    right = np.cumsum(y)
    f1 = 2 * right / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][p[:-1] == p[1:]] = -1
    best = int(f1.argmax())
    below = p[best + 1] if best + 1 < len(p) else 0.0
    return float((p[best] + below) / 2)


def fit(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = ("junk", "toxic"), sample: int = 10_000, buckets: int = 1 << 20) -> Chain:
    """A chain from ``labels``: doc_id and the 0/1 columns named in ``categories``."""
    small_batches(docs.sparkSession)
    columns = [F.col(c).cast("int").alias(f"y{k}") for k, c in enumerate(categories)]
    known = labels.select("doc_id", *columns).where("doc_id is not null and " + " and ".join(f"y{k} in (0, 1)" for k in range(len(categories))))
    known = known.groupBy("doc_id").agg(*(F.max(f"y{k}").alias(f"y{k}") for k in range(len(categories))))
    last = F.col(f"y{len(categories) - 1}")
    counts = {r["y"]: r["count"] for r in known.groupBy(last.alias("y")).count().collect()}
    drawn = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(1 << 30))
    half = sample // 2
    share = F.when(last == 1, F.lit(half * 1.2 / max(1, counts.get(1, 1)))).otherwise(F.lit(half * 1.2 / max(1, counts.get(0, 1))))
    chosen = known.where(drawn / float(1 << 30) < share).withColumn("n", F.row_number().over(Window.partitionBy(last).orderBy(drawn, "doc_id"))).where(F.col("n") <= half).drop("n")
    names = [f"y{k}" for k in range(len(categories))]
    rows = docs.select("doc_id", "text").join(joinable(written(chosen, "toxicity-sample")), "doc_id").select("doc_id", "text", *names)

    @python_task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [word_buckets(t, buckets).astype(np.int32).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), pa.array(at, pa.binary()), *batch.columns[2:]], ["doc_id", "at", *names])

    schema = ", ".join(["doc_id string", "at binary", *(f"{n} int" for n in names)])
    found = sorted((tuple(r) for r in rows.mapInArrow(run, schema).toLocalIterator() if r["at"]), key=lambda r: (hash_order(r[0]), r[0], bytes(r[1])))
    chain = train([np.frombuffer(r[1], np.int32).astype(np.int64) for r in found], np.array([r[2:] for r in found], int).reshape(-1, len(categories)), list(categories), buckets)
    del found
    release()
    return chain


def hash_order(name: str) -> int:
    """Spreads classes over the folds, whatever the ids' order."""
    return zlib.crc32(name.encode())


def predict(docs: DataFrame, chain: Chain, text_col: str = "text", prefix: str = "p_", flag_col: str = "toxic") -> DataFrame:
    """``docs`` with a probability for each category and the flag of the last one; columns of these names are replaced."""
    small_batches(docs.sparkSession)
    new = [*(prefix + c for c in chain.categories), flag_col]
    base = docs.drop(*new)
    at, names = base.columns.index(text_col), [*base.columns, *new]
    shipped = docs.sparkSession.sparkContext.broadcast(chain)  # buckets * categories numbers, both bounded

    @python_task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shipped.value
        for batch in batches:
            p = [c.probabilities(t) for t in batch.column(at).to_pylist()]
            columns = list(zip(*p)) or [()] * len(c.categories)
            flags = [x[-1] >= c.threshold and x[-1] > 0 for x in p]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.float64()) for x in columns), pa.array(flags, pa.bool_())], names)

    kinds = [T.DoubleType()] * len(chain.categories) + [T.BooleanType()]
    return base.mapInArrow(run, T.StructType([*base.schema.fields, *(T.StructField(n, k) for n, k in zip(new, kinds))]))


def report(docs: DataFrame, labels: DataFrame, **kwargs) -> DataFrame:
    """A row for each document: doc_id, a probability p_... for each category, toxic.

    Categories are the label table's 0/1 columns, ``toxic`` last; ``quality`` stands in turned round, as ``junk``. Other
    columns that hold numbers besides 0 and 1, or no 1, are none; a null in a further category counts as 0.
    """
    others = [c for c, kind in labels.dtypes if c not in ("doc_id", "quality", "toxic", "junk") and kind in ("tinyint", "smallint", "int", "bigint", "boolean")]
    value = {c: F.coalesce(F.col(f"`{c}`").cast("int"), F.lit(0)) for c in others}
    fits = labels.agg(F.lit(0), *(F.min((v.isin(0, 1)).cast("int")) + F.max((v == 1).cast("int")) for v in value.values())).first()
    finer = [c for c, fit_sum in zip(others, fits[1:]) if fit_sum == 2]
    known = labels.select("doc_id", (1 - F.col("quality")).alias("junk"), *(value[c].alias(c) for c in finer), "toxic")
    return predict(docs.select("doc_id", "text"), fit(docs, known, ("junk", *finer, "toxic"), **kwargs)).drop("text")
