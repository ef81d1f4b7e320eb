"""Operator 6: language identification with averaged hashed subword embeddings.

A text's subwords are the byte n-grams of its lower-cased letters, with one space for each run of other
characters; each is hashed to a row of an embedding table. The rows' mean goes through a linear softmax. Both
are trained together by stochastic gradient descent in numpy. Training rows are a sample of at most
``per_label`` texts for each label, lowest hash of the id first; a fifth of them, near copies together, is held back to
calibrate: a temperature makes the scores honest, and a text is rejected if its score lies below a bound that but one in
``1 / reject_share`` clean texts should miss. A softmax is sure of some texts in no learned language as well, so a text
is also rejected if the share of its subwords in known buckets - those which hold all but ``rare_share`` of the
subwords learned from - lies below a bound found in the same way. A sample tells such rare cases only by its tail: the
bound carries the distance between its lowest hundredth and thousandth on, as a tail that falls exponentially does, but
not below nine tenths of the sample's least value, where the tail falls more slowly.
Neither bound lies above that of the whole sample, as few held-back texts tell little of the rare ones.

Prediction is map-only over whole texts. Null texts and texts without a letter are ``und`` with score 0 and
rejected. Ties in the sample are broken by the id; repeated rows count each time; null labels are not learned.
Without any labelled text every row is ``und``. Every label is learned; a column with more than ``most_labels`` different
ones is refused, as it can't hold languages.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import joinable, python_task, release, small_batches, written

LETTER = regex.compile(r"\p{L}")
#: ASCII bytes other than letters become spaces; lower() has already run, bytes over 0x7F stay.
LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
UNKNOWN = "und"


def subwords(text: str, buckets: int) -> np.ndarray:
    """Bucket of every byte n-gram (2 to 4) that does not hold a space within."""
    data = b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(LETTERS).split()) + b" "
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    inner, out = b != 32, []
    h = b.copy()
    for n in (1, 2, 3):  # n + 1 bytes
        if len(b) <= n:
            break
        h = h[:-1] * np.uint32(0x9E3779B1) + b[n:]
        mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        mixed = (mixed ^ (mixed >> np.uint32(13))) & np.uint32(buckets - 1)
        ok = np.ones(len(h), bool)
        for k in range(1, n):  # spaces stand at the ends only
            ok &= inner[k : k + len(h)]
        out.append(mixed[ok])
    return np.concatenate(out) if out else np.empty(0, np.uint32)


class Model:
    """labels, a row of ``table`` for each bucket, and ``weights`` from a mean row to the labels' logits (None: the rows are
    logits already, as with few labels; both steps are linear). The table's last column is 1 for known buckets, else 0."""

    def __init__(self, labels: list[str], table: np.ndarray, weights: np.ndarray | None, bias: np.ndarray, temperature: float, least_score: float, least_known: float = 0.0):
        self.labels, self.table, self.weights, self.bias, self.temperature = labels, table, weights, bias, temperature
        self.least_score, self.least_known = least_score, least_known

    def logits(self, means: np.ndarray) -> np.ndarray:
        return (means if self.weights is None else means @ self.weights) + self.bias

    def scores(self, text: str | None) -> tuple[np.ndarray, float] | None:
        """(score of each label, share of subwords in known buckets)"""
        if not self.labels or not text or not LETTER.search(text):
            return None
        at = subwords(text, len(self.table))
        mean = self.table.take(at, 0).mean(0) if len(at) else np.zeros(self.table.shape[1], np.float32)
        z = self.logits(mean[:-1]) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum(), float(mean[-1])

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(label, score, rejected)"""
        found = self.scores(text)
        if found is None:
            return UNKNOWN, 0.0, True
        p, known = found
        best = int(p.argmax())
        return self.labels[best], float(min(1.0, p[best])), bool(p[best] < self.least_score or known < self.least_known)


def train(features: list[tuple[np.ndarray, np.ndarray]], targets: np.ndarray, labels: list[str], buckets: int, dim: int = 16, epochs: int = 6, rate: float = 0.5, reject_share: float = 1e-5, rare_share: float = 0.001, seed: int = 7) -> Model:
    """features: for each text its distinct buckets and their shares of its subwords."""
    rng = np.random.default_rng(seed)
    held = held_back([at for at, _ in features], buckets)
    fit = np.flatnonzero(~held)
    table = rng.normal(0, 0.1, (buckets, dim)).astype(np.float32)
    weights, bias = rng.normal(0, 0.1, (dim, len(labels))).astype(np.float32), np.zeros(len(labels), np.float32)
    step, steps = 0, max(1, epochs * len(fit))
    for _ in range(epochs):
        for i in rng.permutation(fit):
            at, share = features[i]
            now, step = rate * (1 - step / steps), step + 1
            hidden = share @ table[at]
            z = hidden @ weights + bias
            e = np.exp(z - z.max())
            error = e / e.sum()
            error[targets[i]] -= 1
            back = weights @ error
            weights -= now * np.outer(hidden, error)
            bias -= 0.1 * now * error
            table[at] -= (now * 20) * share[:, None] * back[None, :]
    mass = np.zeros(buckets)
    for i in fit:
        mass[features[i][0]] += features[i][1]
    order = np.argsort(-mass, kind="stable")
    known = np.zeros((buckets, 1), np.float32)
    known[order[(np.cumsum(mass[order]) - mass[order] < (1 - rare_share) * mass.sum()) & (mass[order] > 0)]] = 1
    few = len(labels) <= dim
    table = np.hstack([(table @ weights).astype(np.float32) if few else table, known])
    model = Model(labels, table, None if few else weights, bias, 1.0, 0.0)
    check = held if held.any() else ~held
    every = np.stack([share @ table[at] for at, share in features]).astype(np.float64)
    logits = model.logits(every[:, :-1])
    z, wanted = logits[check], targets[check]

    def soft(t: float, z: np.ndarray = z) -> np.ndarray:
        e = np.exp(z / t - (z / t).max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    grid = np.geomspace(0.2, 20, 41)
    temperature = float(grid[np.argmin([-np.log(soft(t)[np.arange(len(wanted)), wanted] + 1e-12).mean() for t in grid])])

    def least(values: np.ndarray) -> float:
        """A thousandth lower, as the sums of shares here and the means of prediction round differently."""
        return 0.999 * min(tail(values[check], reject_share), tail(values, reject_share))

    model.temperature, model.least_score, model.least_known = temperature, least(soft(temperature, logits).max(1)), least(every[:, -1])
    return model


def tail(values: np.ndarray, share: float, least_rows: int = 4) -> float:
    """The value that a ``share`` of all misses, carried on from the lowest quantile that ``least_rows`` values support."""
    known = min(0.1, max(share, least_rows / len(values)))
    low, high = np.quantile(values, [known, 10 * known], method="lower")
    return float(max(low - (high - low) * max(0.0, np.log10(known / share)), 0.9 * values.min()))


def held_back(buckets_of: list[np.ndarray], buckets: int, common: float = 0.05) -> np.ndarray:
    """Marks about a fifth of the texts, by the least hash of the buckets that few texts have: near copies share most of
    these and so fall on the same side."""
    if len(buckets_of) < 50:
        return np.zeros(len(buckets_of), bool)
    texts = np.zeros(buckets, np.int64)
    for at in buckets_of:
        texts[at] += 1
    mixed = (np.arange(buckets, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)
    rare = texts <= max(2, common * len(buckets_of))
    least = np.array([int(mixed[some].min()) if len(some := at[rare[at]]) else n for n, at in enumerate(buckets_of)])
    return least % 5 == 4


def fit(docs: DataFrame, learn: Column, buckets: int = 1 << 16, per_label: int = 1000, most_labels: int = 10_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Model:
    """A model from the rows where ``learn`` holds. What comes to the driver is bounded: ``per_label`` texts of each label,
    and for a text no more than ``buckets`` numbers."""
    small_batches(docs.sparkSession)
    usable = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(label_col).cast("string").alias("l")).where(learn & F.col(label_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    counts = usable.groupBy("l").count().limit(most_labels + 1).collect()
    if len(counts) > most_labels:
        raise ValueError(f"{label_col} has more than {most_labels} different values")
    labels = sorted(r["l"] for r in counts)
    nothing = Model([], np.zeros((buckets, 1), np.float32), None, np.zeros(1, np.float32), 1.0, 1.0)
    if not labels:
        return nothing
    # by a share of each label's rows, so that only a few more than wanted are sorted
    drawn = F.xxhash64(F.lit(11), F.col("i"))
    shares = docs.sparkSession.createDataFrame([(r["l"], min(1.0, (per_label + 6 * per_label**0.5 + 20) / r["count"])) for r in counts], usable.select("l").schema.add("share", "double"))
    near = usable.select("i", "l", drawn.alias("h")).join(F.broadcast(shares), "l").where(F.pmod("h", F.lit(1 << 30)) / F.lit(float(1 << 30)) < F.col("share"))  # a row for each label
    chosen = near.withColumn("n", F.row_number().over(Window.partitionBy("l").orderBy(F.pmod("h", F.lit(1 << 30)), "i"))).where(F.col("n") <= per_label).select("i").distinct()
    sample = usable.join(joinable(written(chosen, "language-sample")), "i", "left_semi").select("i", "l", "t")

    @python_task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, share = [], []
            for text in batch.column(2).to_pylist():
                values, counts = np.unique(subwords(text, buckets), return_counts=True)
                at.append(values.astype(np.uint32).tobytes())
                share.append((counts / max(1, counts.sum())).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1).cast(pa.string()), pa.array(at, pa.binary()), pa.array(share, pa.binary())], ["i", "l", "at", "share"])

    rows = sorted((r for r in sample.mapInArrow(run, "i string, l string, at binary, share binary").toLocalIterator() if r["at"]), key=lambda r: (hash_of(r["i"]), r["l"], r["at"]))
    if not rows:
        return nothing
    features = [(np.frombuffer(r["at"], np.uint32), np.frombuffer(r["share"], np.float32)) for r in rows]
    number = {label: n for n, label in enumerate(labels)}
    model = train(features, np.array([number[r["l"]] for r in rows]), labels, buckets)
    del rows, features
    release()
    return model


def hash_of(text: str) -> int:
    return zlib.crc32(text.encode() + b"order")


def predict(docs: DataFrame, model: Model, text_col: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """``docs`` with the predicted label, the calibrated score and the rejection; columns of these names are replaced."""
    small_batches(docs.sparkSession)
    base = docs.drop(*names)
    at, columns = base.columns.index(text_col), [*base.columns, *names]
    schema = T.StructType([*base.schema.fields, *(T.StructField(n, k) for n, k in zip(names, (T.StringType(), T.DoubleType(), T.BooleanType())))])
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # buckets * labels numbers, both bounded

    @python_task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for batch in batches:
            out = list(zip(*map(m.predict, batch.column(at).to_pylist()))) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out[0], pa.string()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.bool_())], columns)

    return base.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text is divisible by 5 (null ids: held out)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def report(docs: DataFrame, **kwargs) -> DataFrame:
    """A row for each document: doc_id, held_out, lang_pred, score, rejected; learned from the rows not held out."""
    model = fit(docs, ~held_out("i"), **kwargs)
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")
