"""Operator 4: quality rules by line sequence labelling.

A linear-chain conditional random field labels the lines of a text content (0) or boilerplate (1); Viterbi
decoding finds the best sequence, and a document is kept if content lines hold at least ``least_content`` of its
word characters. Lines without a word are not labelled. The field is trained here by gradient ascent of the
regularised likelihood on a sample of at most ``sample`` labelled documents (lowest hash of the id first): lines
of good documents are content, lines of poor ones boilerplate, and to learn where one turns into the other, poor
documents are also joined to good ones, before and after. A sampled document is learned from with all its lines;
of each kind, documents are taken in that order until they hold ``line_budget`` lines; one that is labelled both good
and poor counts as poor. Before the field come two plain rules: too few
words, or too many words in repeated three-word windows.

Null and empty texts have no words and fail the first rule. Every row is judged on its own, so ties, repeated
rows and further columns have no effect; new columns replace those of the same name. Without labelled
documents of both kinds the field marks nothing.
"""

from __future__ import annotations

import re
from bisect import insort
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import joinable, python_task, release, small_batches, written

SPACE = re.compile(r"[\x20\x09-\x0D]")
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
SIGNS = "#*$%&|<>"
SIGN_BYTES = SIGNS.encode()
#: For counting classes of bytes at C speed.
NOT_UPPER = bytes(c for c in range(256) if not 65 <= c <= 90)
NOT_LOWER = bytes(c for c in range(256) if not (97 <= c <= 122 or c >= 128))
NOT_DIGIT = bytes(c for c in range(256) if not 48 <= c <= 57)
NOT_SIGN = bytes(c for c in range(256) if c not in SIGN_BYTES)
NOT_MARK = bytes(c for c in range(256) if c not in b"!?")
N_FEATURES = 9


def line_features(line: bytes, words: list[bytes], repeated: bool) -> list[float]:
    """Shares of signs, capitals, digits, loud marks, repeated words; a repeated line; shortness; a constant."""
    n = sum(map(len, words))
    upper, lower = len(line.translate(None, NOT_UPPER)), len(line.translate(None, NOT_LOWER))
    counts = Counter(words)
    loose = sum(k for w, k in counts.items() if not w.translate(None, SIGN_BYTES))
    return [
        1.0,
        min(1.0, 4 * len(line.translate(None, NOT_SIGN)) / n),
        upper / (upper + lower) if upper + lower else 0.0,
        len(line.translate(None, NOT_DIGIT)) / n,
        min(1.0, 4 * len(line.translate(None, NOT_MARK)) / n),
        1.0 - len(counts) / len(words) if len(words) > 2 else 0.0,
        1.0 if repeated else 0.0,
        1.0 / len(words),
        loose / len(words),
    ]


def sequence(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of each line with a word, and the word bytes that it holds."""
    rows, sizes, seen = [], [], set()
    for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
        words = line.split()
        if words:
            rows.append(line_features(line, words, line in seen))
            sizes.append(sum(map(len, words)))
            seen.add(line)
    return np.array(rows, np.float64).reshape(-1, N_FEATURES), np.array(sizes, np.int64)


class Field:
    """weights: features x 2; steps: 2 x 2, from the label before to the next."""

    def __init__(self, weights: np.ndarray, steps: np.ndarray):
        self.weights, self.steps = weights, steps

    def viterbi(self, features: np.ndarray) -> np.ndarray:
        node = features @ self.weights
        n = len(node)
        back = np.zeros((n, 2), np.int8)
        (a, b), ((aa, ab), (ba, bb)) = node[0].tolist(), self.steps.tolist()
        for i, (x, y) in enumerate(node[1:].tolist(), 1):
            to_a, to_b = a + aa >= b + ba, a + ab >= b + bb
            back[i] = (0 if to_a else 1, 0 if to_b else 1)
            a, b = (a + aa if to_a else b + ba) + x, (a + ab if to_b else b + bb) + y
        path = np.zeros(n, np.int8)
        path[-1] = 0 if a >= b else 1
        for i in range(n - 1, 0, -1):
            path[i - 1] = back[i, path[i]]
        return path

    def content_share(self, text: str | None) -> float:
        """Share of word bytes in content lines; no words: 0."""
        features, sizes = sequence(text or "")
        return float(sizes[self.viterbi(features) == 0].sum() / sizes.sum()) if len(sizes) else 0.0


NOTHING = Field(np.zeros((N_FEATURES, 2)), np.zeros((2, 2)))


def joined(sequences: list[tuple[np.ndarray, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Features and a label for each line: of the sequences, and of pairs with different labels, in turns this one and
    that one first."""
    out = [(f, np.full(len(f), label)) for f, label in sequences]
    kinds = [[s for s in out if s[1][0] == kind] for kind in (0, 1)]
    for n, (content, other) in enumerate(zip(*kinds)):
        first, then = (content, other) if n % 2 else (other, content)
        out.append((np.concatenate([first[0], then[0]]), np.concatenate([first[1], then[1]])))
    return out


def train(sequences: list[tuple[np.ndarray, int]], rounds: int = 150, rate: float = 0.5, ridge: float = 1e-3) -> Field:
    """Sequences of line features with one label each, and these joined in pairs; gradient of the chain's likelihood by
    forward-backward, over all sequences at once, position by position."""
    if len({label for _, label in sequences}) < 2:
        return NOTHING
    labelled = sorted(joined(sequences), key=lambda s: -len(s[0]))
    lengths = np.array([len(f) for f, _ in labelled])
    labels = np.concatenate([l for _, l in labelled])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    x = np.concatenate([f for f, _ in labelled])
    gold = np.zeros((len(x), 2))
    gold[np.arange(len(x)), labels] = 1
    active = [int((lengths > t).sum()) for t in range(int(lengths[0]))]
    # whatever their numbers, content lines weigh four times as much as boilerplate: losing good text costs more
    weight = np.where(labels == 1, 0.2 / (labels == 1).sum(), 0.8 / (labels == 0).sum())
    w, s = np.zeros((N_FEATURES, 2)), np.zeros((2, 2))
    velocity_w, velocity_s = np.zeros_like(w), np.zeros_like(s)
    for _ in range(rounds):
        node = x @ w
        alpha, beta = np.zeros_like(node), np.zeros_like(node)
        alpha[starts] = node[starts]
        for t in range(1, len(active)):
            k = starts[: active[t]] + t
            alpha[k] = node[k] + np.logaddexp(alpha[k - 1, 0, None] + s[0], alpha[k - 1, 1, None] + s[1])
        for t in range(len(active) - 1, 0, -1):
            k = starts[: active[t]] + t
            beta[k - 1] = np.logaddexp(node[k, 0, None] + beta[k, 0, None] + s[:, 0], node[k, 1, None] + beta[k, 1, None] + s[:, 1])
        total = np.logaddexp(alpha[:, 0] + beta[:, 0], alpha[:, 1] + beta[:, 1])
        p = np.exp(alpha + beta - total[:, None])
        grad_w = x.T @ ((gold - p) * weight[:, None]) - ridge * w
        grad_s = -ridge * s
        for t in range(1, len(active)):
            k = starts[: active[t]] + t
            pair = np.exp(alpha[k - 1][:, :, None] + s + (node[k] + beta[k])[:, None, :] - total[k][:, None, None])
            grad_s = grad_s + ((gold[k - 1][:, :, None] * gold[k][:, None, :] - pair) * weight[k][:, None, None]).sum(0)
        velocity_w, velocity_s = 0.9 * velocity_w + grad_w, 0.9 * velocity_s + grad_s
        w, s = w + rate * velocity_w, s + rate * velocity_s
    return Field(w, s)


def fit(docs: DataFrame, labels: DataFrame, sample: int = 3000, line_budget: int = 100_000) -> Field:
    """A field from ``labels`` (doc_id, quality). At most ``sample`` documents of each kind come to the driver, as
    features of all their lines; of these ``within`` the budget stay."""
    small_batches(docs.sparkSession)
    known = labels.select("doc_id", F.col("quality").cast("int").alias("q")).where("doc_id is not null and q in (0, 1)").groupBy("doc_id").agg(F.min("q").alias("q"))
    counts = {r["q"]: r["count"] for r in known.groupBy("q").count().collect()}
    drawn = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 30))
    share = F.when(F.col("q") == 0, F.lit(sample * 1.2 / max(1, counts.get(0, 1)))).otherwise(F.lit(sample * 1.2 / max(1, counts.get(1, 1))))
    chosen = known.where(drawn / float(1 << 30) < share).withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(drawn, "doc_id"))).where(F.col("n") <= sample).select("doc_id", "q")
    rows = docs.select("doc_id", "text").join(joinable(written(chosen, "quality-sample")), "doc_id").select("doc_id", "q", "text", drawn.alias("drawn"))

    @python_task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [sequence(t or "")[0].astype(np.float32).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1), pa.array(data, pa.binary()), batch.column(3)], ["doc_id", "q", "lines", "drawn"])

    found = within(line_budget, ((r["drawn"], r["doc_id"], r["q"], bytes(r["lines"])) for r in rows.mapInArrow(run, "doc_id string, q int, lines binary, drawn long").toLocalIterator()))
    field = train([(np.frombuffer(b, np.float32).reshape(-1, N_FEATURES).astype(np.float64), 1 - q) for _, q, b in found if b])
    del found
    release()
    return field


def within(budget: int, rows: Iterable[tuple[int, str, int, bytes]]) -> list[tuple[str, int, bytes]]:
    """Of (place, id, kind, lines) those before which, by place, their kind has fewer than ``budget`` lines; by id. The
    last is dropped as soon as the others fill the budget, so little more than that is held, whatever the rows' order."""
    kept: dict[int, list] = {}
    total: Counter[int] = Counter()
    size = lambda lines: len(lines) // (4 * N_FEATURES)
    for row in rows:
        of_kind = kept.setdefault(row[2], [])
        insort(of_kind, row)
        total[row[2]] += size(row[3])
        while total[row[2]] - size(of_kind[-1][3]) >= budget:
            total[row[2]] -= size(of_kind.pop()[3])
    return sorted(row[1:] for of_kind in kept.values() for row in of_kind)


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    w = np.fromiter((number.setdefault(x, len(number)) for x in words), np.int64, n)
    _, pair = np.unique(w[:-2] * len(number) + w[1:-1], return_inverse=True)
    _, triple, count = np.unique(pair.astype(np.int64) * len(number) + w[2:], return_inverse=True, return_counts=True)
    again = count[triple] > 1
    if not again.any():
        return 0
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= again
    return int(covered.sum())


def measures(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    chars = len(text) - (len(data) - sum(map(len, words)))  # every byte outside words is one code point
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    return len(words), chars, len(data.translate(None, NOT_SIGN)), len(lines) - len(set(lines)), repeated_words(words)


NEW = (("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()), ("base_failed", T.BooleanType()), ("content_share", T.DoubleType()), ("kept", T.BooleanType()))


def judge(docs: DataFrame, field: Field, least_words: int = 50, most_repeated: int = 50, least_content: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` with the measures, base_failed, content_share (null after a failed rule) and kept."""
    small_batches(docs.sparkSession)
    base = docs.drop(*(n for n, _ in NEW))
    at, names = base.columns.index(text_col), [*base.columns, *(n for n, _ in NEW)]

    @python_task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(at).to_pylist():
                m = measures(text)
                failed = m[0] < least_words or 100 * m[4] > most_repeated * m[0]
                share = None if failed else field.content_share(text)
                rows.append((*m, failed, share, not failed and share >= least_content))
            new = list(zip(*rows)) or [()] * len(NEW)
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(new, kinds))], names)

    return base.mapInArrow(run, T.StructType([*base.schema.fields, *(T.StructField(n, k) for n, k in NEW)]))


def report(docs: DataFrame, labels: DataFrame, **kwargs) -> DataFrame:
    return judge(docs.select("doc_id", "text"), fit(docs, labels), **kwargs).drop("text")
