"""Operator 10: benchmark decontamination with a generalised suffix automaton.

Test items, normalised to words, are built into one automaton over word numbers. Documents are streamed
through it: after each word the state and the length of the longest match ending there are known. A match of
at least ``window`` words holds a window of some item; an item of fewer words is a window as a whole. Words
inside windows are hits. Only stretches of words that occur in the items and are long enough to hold a window
are streamed, since any other word leads back to the root.

Null or empty texts have no words: no hits, not contaminated. Items without words have no window; an item with
a null id hits but is not listed; items with the same id are one. Rows are judged one by one, so ties, repeated
rows and further columns of any name have no effect. An empty item table leaves every document clean.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import python_task, small_batches, written

#: Bytes outside words become spaces; A-Z become a-z. Digits, letters and all bytes over 0x7F stay.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")


def normal_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(NORMAL).split() if text else []


class Automaton:
    """Generalised suffix automaton of word sequences, with the items of each window."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.window = window
        self.number: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.short: dict[int, set] = {}  # state of a whole short item -> item ids
        self.least = window
        sequences = []
        for item, text in items:
            words = [self.number.setdefault(w, len(self.number)) for w in normal_words(text)]
            if words:
                last = 0
                for word in words:
                    last = self._extend(last, word)
                sequences.append((item, words))
                self.least = min(self.least, len(words))
        for item, words in sequences:
            if len(words) < window:
                state = 0
                for word in words:
                    state = self.next[state][word]
                self.short.setdefault(state, set()).add(item)
        self.long: dict[int, set] = {}  # state of a window -> item ids
        for item, words in sequences:
            if len(words) >= window:
                for _, state, length in self.stream(words):
                    if length >= window:
                        self.long.setdefault(self._window_state(state), set()).add(item)
        self.above: list[tuple[int, ...]] = []  # for each state: the short items' states at or above it
        if self.short:
            self.above = [()] * len(self.link)
            for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
                up = self.above[self.link[state]] if self.link[state] > 0 else ()
                self.above[state] = (state, *up) if state in self.short else up

    def _new(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, parent: int, word: int, state: int) -> int:
        """A copy of ``state`` for the strings that end after ``parent``."""
        copy = self._new(self.length[parent] + 1, self.link[state], dict(self.next[state]))
        self.link[state] = copy
        while parent >= 0 and self.next[parent].get(word) == state:
            self.next[parent][word] = copy
            parent = self.link[parent]
        return copy

    def _extend(self, last: int, word: int) -> int:
        present = self.next[last].get(word)
        if present is not None:
            return present if self.length[present] == self.length[last] + 1 else self._split(last, word, present)
        state, parent = self._new(self.length[last] + 1, 0, {}), last
        while parent >= 0 and word not in self.next[parent]:
            self.next[parent][word] = state
            parent = self.link[parent]
        if parent >= 0:
            onward = self.next[parent][word]
            self.link[state] = onward if self.length[onward] == self.length[parent] + 1 else self._split(parent, word, onward)
        return state

    def stream(self, words) -> Iterator[tuple[int, int, int]]:
        """(index, state, longest matching length) after each word."""
        state = length = 0
        following, link, lengths = self.next, self.link, self.length
        for i, word in enumerate(words):
            onward = following[state].get(word)
            while onward is None and state:
                state = link[state]
                length = lengths[state]
                onward = following[state].get(word)
            if onward is None:
                length = 0
            else:
                state = onward
                length += 1
            yield i, state, length

    def _window_state(self, state: int) -> int:
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def hits(self, words: list[bytes]) -> tuple[np.ndarray | None, set]:
        """Which words lie in windows (None: none does), and the ids of the items with occurring windows."""
        if len(words) < self.least or not self.number:
            return None, set()
        numbers = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (numbers >= 0).view(np.int8), [0]))))
        begins, ends = edges[::2], edges[1::2]
        long_enough = ends - begins >= self.least
        if not long_enough.any():
            return None, set()
        mask, found = np.zeros(len(words), bool), set()
        window, lengths = self.window, self.length
        for begin, end in zip(begins[long_enough].tolist(), ends[long_enough].tolist()):
            for i, state, length in self.stream(numbers[begin:end].tolist()):
                if length >= window:
                    mask[begin + i - window + 1 : begin + i + 1] = True
                    found |= self.long[self._window_state(state)]
                if self.above:
                    for short in self.above[state]:
                        if lengths[short] <= length:
                            mask[begin + i - lengths[short] + 1 : begin + i + 1] = True
                            found |= self.short[short]
        return (mask if mask.any() else None), found


def sharded(items: DataFrame, item_col: str, text_col: str, shard_bytes: int) -> tuple[DataFrame, int]:
    """(shard, item, text) and the number of shards: a shard holds about ``shard_bytes`` of text. All windows of an item
    lie in one shard."""
    rows = items.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // shard_bytes))
    return rows.select(F.pmod(F.xxhash64("item", "text"), F.lit(n)).cast("int").alias("shard"), "item", "text"), n


def scan(docs: DataFrame, items: DataFrame, window: int = 13, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shard_bytes: int = 16 << 20, prefix: str = "decon_", cut_over: int | None = None) -> DataFrame:
    """``docs`` with ``decon_mask`` (packed bits, one a word; null without hits), ``decon_items``,
    ``decon_words`` and ``decon_hits`` (counts).

    One shard of the items, of about ``shard_bytes``, is on the driver and in a task at a time. With several, each is
    one pass over the rows as the pass before has written them, adding its hits; documents are never shuffled.
    Columns of ``docs`` with the new names are replaced. With ``cut_over`` the last pass gives the columns of ``docs`` only:
    rows of which hits make up 1/``cut_over`` or more are gone, from others the matched spans are cut.
    """
    small_batches(docs.sparkSession)
    mask_col, items_col, words_col, hits_col = (prefix + x for x in ("mask", "items", "words", "hits"))
    base = docs.drop(mask_col, items_col, words_col, hits_col)
    at, width = base.columns.index(text_col), len(base.columns)
    schema = T.StructType([*base.schema.fields, T.StructField(mask_col, T.BinaryType()), T.StructField(items_col, T.ArrayType(T.StringType())), T.StructField(words_col, T.LongType()), T.StructField(hits_col, T.LongType())])
    names = schema.names
    out = base
    rows, n_shards = sharded(items, item_col, item_text_col, shard_bytes)
    for n in range(n_shards):
        part = [(r["item"], r["text"]) for r in rows.where(F.col("shard") == n).toLocalIterator()]
        shipped = docs.sparkSession.sparkContext.broadcast(part)  # one shard

        @python_task
        def run(batches: Iterator[pa.RecordBatch], n=n, shipped=shipped, cutting=cut_over is not None and n + 1 == n_shards) -> Iterator[pa.RecordBatch]:
            automaton = Automaton(shipped.value, window)
            for batch in batches:
                masks, found, counts, hits = [], [], [], []
                before = batch.column(width).to_pylist() if n else repeat(None)
                known = batch.column(width + 1).to_pylist() if n else repeat(None)
                for text, old, ids in zip(batch.column(at).to_pylist(), before, known):
                    words = normal_words(text)
                    mask, new = automaton.hits(words)
                    bits = np.packbits(mask).tobytes() if mask is not None else None
                    if old is not None:
                        bits = old if bits is None else (np.frombuffer(old, np.uint8) | np.frombuffer(bits, np.uint8)).tobytes()
                    masks.append(bits)
                    found.append(sorted({*(ids or ()), *(i for i in new if i is not None)}))
                    counts.append(len(words))
                    hits.append(int(np.unpackbits(np.frombuffer(bits, np.uint8)).sum()) if bits else 0)
                if cutting:
                    kept = pa.array([not over(h, c, cut_over) for h, c in zip(hits, counts)], pa.bool_())
                    columns = list(batch.columns[:width])
                    if any(hits):
                        columns[at] = pa.array([t if m is None else without_spans(t, m) for t, m in zip(columns[at].to_pylist(), masks)], pa.string())
                    yield pa.RecordBatch.from_arrays(columns, names[:width]).filter(kept)
                    continue
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(masks, pa.binary()), pa.array(found, pa.list_(pa.string())), pa.array(counts, pa.int64()), pa.array(hits, pa.int64())], names)

        out = out.mapInArrow(run, base.schema if cut_over is not None and n + 1 == n_shards else schema)
        if n + 1 < n_shards:
            out = written(out, "decontaminated")
            shipped.unpersist()
    return out


def report(docs: DataFrame, items: DataFrame, window: int = 13, coverage: int = 20, id_col: str = "doc_id", text_col: str = "text", **kwargs) -> DataFrame:
    """A row for each document: id, n_words, n_hit, n_items, items_sha256, contaminated (hits make up 1/``coverage`` or more)."""
    found = scan(docs.select(id_col, text_col), items, window, text_col, **kwargs)
    return found.select(
        id_col,
        F.col("decon_words").alias("n_words"),
        F.col("decon_hits").alias("n_hit"),
        F.size("decon_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("decon_items")), 256).alias("items_sha256"),
        over(F.col("decon_hits"), F.col("decon_words"), coverage).alias("contaminated"),
    )


def over(hits, words, coverage: int):
    """Hits make up 1/``coverage`` of the words or more; of columns or numbers."""
    return (hits > 0) & (hits * coverage >= words)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 13, coverage: int = 20, text_col: str = "text", **kwargs) -> DataFrame:
    """``docs`` without those over the coverage limit; from the others, matched spans of words are cut out of the
    text together with the white space and signs after them. Columns stay as they are."""
    prefix = "decon_"
    while any(name.startswith(prefix) for name in docs.columns):
        prefix += "_"
    return scan(docs, items, window, text_col, prefix=prefix, cut_over=coverage, **kwargs)


def without_spans(text: str, mask: bytes) -> str:
    bits = np.unpackbits(np.frombuffer(mask, np.uint8))
    out, kept_to, cutting = [], 0, False
    for i, word in enumerate(WORD.finditer(text)):
        if bits[i] and not cutting:
            out.append(text[kept_to : word.start()])
        elif cutting and not bits[i]:
            kept_to = word.start()
        cutting = bool(bits[i])
    return "".join(out) + ("" if cutting else text[kept_to:])
