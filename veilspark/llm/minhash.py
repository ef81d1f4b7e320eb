"""Operator 7: near-duplicates by min-max hashing.

A document's set is that of its distinct word shingles. Under each random permutation both the least and the
greatest value are kept, so ``perms`` permutations give 2 * perms signature values, half the evaluations of plain
minwise hashing; two sets agree in any of them with the probability of their similarity. Bands of ``rows``
values name buckets. Defaults (176 permutations, 44 bands of 8 values): a pair at similarity 0.85 shares no
bucket with probability 7e-7, one at 0.3 shares one with probability 0.3 %.

Steps: (1) signatures, map-only; (2) equal sets become one node, their least id; (3) buckets with two nodes or
more chain nodes into clusters (links to the bucket's least node, then components) - no pair is formed; (4) a
cluster of at most ``block`` nodes is compared by one task, first by all signature values, then on full sets; pairs
already joined are skipped, so a task returns a spanning forest, fewer links than it has nodes; (5) in a larger cluster
all nodes are first compared with ``central`` ones - half of them those that share the most with others, half drawn by
hash - and then only nodes outside the largest part that this joins are compared, in blocks, with all others. So near
copies of one text cost a few comparisons each, and pairs are all compared only among nodes that no central one joins;
(6) components of all links.

Rows with the same id are one document. A null id has no component: such rows come back with a null
component_id, kept, linked with nothing. Without words: an empty set, linked with nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import joinable, python_task, scratch, shared_dir, small_batches, word_hashes, words_of, written
from .components import components

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def shingle_set(words: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words than ``size`` are one shingle."""
    if not words:
        return np.empty(0, np.uint64)
    w = word_hashes(words)
    size = min(size, len(w))
    n = len(w) - size + 1
    h = np.full(n, np.uint64(size))
    for j in range(size):
        h = (h ^ w[j : j + n]) * _MIX[0]
        h ^= h >> np.uint64(29)
    h *= _MIX[1]
    h ^= h >> np.uint64(32)
    return np.unique(h)


class Signer:
    def __init__(self, perms: int, bands: int, rows: int, seed: int = 20240229):
        rng = np.random.default_rng(seed)
        self.a = (rng.integers(0, 1 << 32, perms, dtype=np.uint64).astype(np.uint32) | np.uint32(1))[:, None]
        self.b = rng.integers(0, 1 << 32, perms, dtype=np.uint64).astype(np.uint32)[:, None]
        if bands * rows > 2 * perms:
            raise ValueError("bands * rows exceeds the 2 * perms signature values")
        self.order = rng.permutation(2 * perms)[: bands * rows].reshape(bands, rows)
        self.band_ids = np.arange(1, bands + 1, dtype=np.uint64)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles >> np.uint64(32)).astype(np.uint32)[None, :]
        least = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        most = np.zeros(len(self.a), np.uint32)
        for i in range(0, x.shape[1], 4096):  # bounded working space for very long documents
            v = x[:, i : i + 4096] * self.a
            v += self.b
            np.minimum(least, v.min(1), out=least)
            np.maximum(most, v.max(1), out=most)
        return np.concatenate([least, most])

    def bands(self, signature: np.ndarray) -> np.ndarray:
        """One 64-bit key for each band, the band's number mixed in."""
        values = signature[self.order].astype(np.uint64)
        h = self.band_ids * _MIX[2]
        for j in range(values.shape[1]):
            h = (h ^ values[:, j]) * _MIX[0]
            h ^= h >> np.uint64(31)
        return (h * _MIX[1]).view(np.int64)


def features(docs: DataFrame, shingle: int, signer: Signer, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_shingles, digest, bands) of every row; digest and bands are null for empty sets."""
    small_batches(docs.sparkSession)

    @python_task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, bands = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(words_of(text), shingle)
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                bands.append(signer.bands(signer.signature(s)) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "digest", "bands"])

    return docs.select(id_col, text_col).mapInArrow(run, "doc_id long, n_shingles long, digest binary, bands array<bigint>")


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def forest(left: list, right: list | None, signer: Signer, percent: int, least_share: float) -> list[tuple[int, int]]:
    """Links (i, j) that join similar members of ``left`` (or of left and right), none where already joined.

    Members are (node, part, set); members of one part are joined already. least_share: pairs whose signatures agree in a
    smaller share are not similar enough.
    """
    members = left + (right or [])
    first: dict[int, int] = {}
    up = [first.setdefault(part, i) for i, (_, part, _) in enumerate(members)]

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    low = np.stack([signer.signature(s) for *_, s in members]).astype(np.uint8)
    size = np.array([len(s) for *_, s in members])
    least_equal = least_share * low.shape[1]
    links = []
    for i in range(len(left)):
        begin = len(left) if right is not None else i + 1
        if begin >= len(members):
            continue
        # sizes that could reach the similarity, then signatures
        n = size[begin:]
        close = (100 * np.minimum(n, size[i]) >= percent * np.maximum(n, size[i])) & ((low[begin:] == low[i]).sum(1) >= least_equal)
        for j in np.flatnonzero(close) + begin:
            a, b = root(i), root(int(j))
            if a != b and alike(members[i][2], members[j][2], percent):
                up[a] = b
                links.append((members[i][0], members[j][0]))
    return links


def near_duplicates(docs: DataFrame, percent: int = 85, shingle: int = 5, perms: int = 176, bands: int = 44, rows: int = 8, block: int = 256, central: int = 8, spread: float = 6.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id, kept. Links need ``percent`` of the union in common.

    Signatures agree in a share that spreads around the similarity by sqrt(0.85 * 0.15 / (2 * perms)); pairs
    more than ``spread`` such spreads below the threshold (one in 10^9 of those at it) are dropped before the full sets
    are compared.
    """
    spark = docs.sparkSession
    signer = Signer(perms, bands, rows)
    t = percent / 100
    least_share = max(0.0, t - spread * (t * (1 - t) / (2 * perms)) ** 0.5)
    with scratch(spark) as kept:  # the tables on the way go
        kept.append(path := shared_dir(spark, "minhash-features"))
        found = features(docs, shingle, signer, id_col, text_col)
        found.write.parquet(path)
        found = spark.read.schema(found.schema).parquet(path)
        named = found.where("digest is not null and doc_id is not null")
        nodes = written(named.groupBy("digest").agg(F.min("doc_id").alias("node"), F.max("n_shingles").alias("n")), "minhash-nodes")
        # rows with one id but several texts: the id joins them
        same_id = named.groupBy("doc_id").agg(F.min("digest").alias("d1"), F.max("digest").alias("d2")).where("d1 <> d2").select("doc_id")
        by_id = named.join(same_id, "doc_id", "left_semi").select("doc_id", "digest").join(nodes.select("digest", "node"), "digest").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))

        firsts = named.join(nodes.select("digest", F.col("node").alias("doc_id")), ["digest", "doc_id"], "left_semi").select(F.col("doc_id").alias("node"), F.explode("bands").alias("band"))
        banded = written(firsts, "minhash-bands")  # a repeated row repeats its bands, which does no harm
        heads = banded.groupBy("band").agg(F.min("node").alias("a"), F.max("node").alias("z"), F.count("*").alias("n")).where("a <> z").select("band", "a", "n")
        met = written(banded.join(heads, "band").groupBy("node", "a").agg(F.sum("n").alias("shared")), "minhash-met")
        chains = met.where("node <> a").select("a", F.col("node").alias("b"))
        clusters = written(components(chains), "minhash-clusters")

        sizes = clusters.groupBy("component").agg(F.count("*").alias("size"))
        member = written(clusters.join(sizes, "component").join(nodes.select("node", "digest"), "node").select("node", "digest", "component", "size"), "minhash-members")
        texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text"))
        sets = _sets(joinable(member).join(texts, "node"), shingle)
        compare = _comparison(signer, percent, least_share)
        links = sets.where(F.col("size") <= block).select("component", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(False).alias("second"), "node", F.col("node").alias("part"), "digest", "shingles").groupBy("component", "i", "j").applyInPandas(compare, LINK)
        large = member.where(F.col("size") > block)
        if not large.isEmpty():
            sets = written(sets.where(F.col("size") > block).select("node", "digest", "component", "shingles").dropDuplicates(["node", "digest"]), "minhash-large")
            links = links.unionByName(_large(sets, met, compare, percent, block, central))
        linked = components(links.unionByName(by_id))
        rep = nodes.join(linked, "node", "left").select("digest", F.coalesce("component", "node").alias("node_component"))
        kept.append(path := shared_dir(spark, "minhash-result"))
        rep.write.parquet(path)
    rep = spark.read.schema(rep.schema).parquet(path)
    return (
        found.select("doc_id", "n_shingles", "digest")
        .join(rep, "digest", "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("node_component", "doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


LINK = "a long, b long"


def _comparison(signer: Signer, percent: int, least_share: float):
    """Compares the members of a group: all with each other, or the first with the second ones."""

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node", kind="stable").drop_duplicates(["node", "digest", "second"])
        pick = lambda g: [(int(n), int(p), np.frombuffer(s, np.uint64)) for n, p, s in zip(g["node"], g["part"], g["shingles"])]
        left, right = pick(group[~group["second"]]), pick(group[group["second"]]) or None
        links = forest(left, right, signer, percent, least_share) if left else []
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return compare


def _large(sets: DataFrame, met: DataFrame, compare, percent: int, block: int, central: int) -> DataFrame:
    """Links of clusters of more than ``block`` nodes. sets: (node, digest, component, shingles); met: (node, a, shared), with
    how many nodes a node shares buckets, by the least of each bucket."""
    ids = written(sets.select("node", "component").distinct(), "minhash-large-ids")
    score = met.groupBy("node").agg(F.sum("shared").alias("score"))
    scored = ids.join(score, "node", "left").select("node", "component", F.coalesce("score", F.lit(0)).alias("score"), F.xxhash64(F.lit(3), "node").alias("drawn"))
    place = lambda *order: F.row_number().over(Window.partitionBy("component").orderBy(*order))  # noqa: E731  with the limit below, few rows of a cluster leave each task
    best = [scored.select("node", "component", place(*order).alias("n")).where(F.col("n") <= central // 2).drop("n") for order in ((F.desc("score"), "node"), ("drawn", "node"))]
    chosen = written(best[0].union(best[1]).distinct().join(sets, ["node", "component"]).select(F.col("node").alias("b"), "component", F.col("shingles").alias("y")), "minhash-central")

    @python_task
    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (c.to_pylist() for c in batch.columns[2:])
            fits = [alike(np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64), percent) for s, t in zip(x, y)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(fits, pa.bool_()))

    pairs = sets.join(joinable(chosen), "component").where("node <> b").select(F.col("node").alias("a"), "b", F.col("shingles").alias("x"), "y")
    found = written(pairs.mapInArrow(verified, LINK), "minhash-central-links")
    joined = components(found).select("node", F.col("component").alias("joined"))
    state = written(ids.join(joined, "node", "left").select("node", "component", F.coalesce("joined", "node").alias("part")), "minhash-parts")

    parts = state.groupBy("component", "part").agg(F.count("*").alias("size"))
    largest = parts.groupBy("component").agg(F.max(F.struct("size", "part")).alias("most")).select("component", F.col("most.part").alias("main"))
    rest = written(state.join(largest, "component").where("part <> main").select("node", "component"), "minhash-rest")
    counts = rest.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("rows")).join(ids.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("columns")), "component")
    all_of = state.select("node", "part").join(sets, "node").join(counts, "component")
    row, column = (F.pmod(F.xxhash64(F.lit(k), "node"), F.col(of)).cast("int") for k, of in ((1, "rows"), (2, "columns")))
    each = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    left = all_of.join(rest, ["node", "component"], "left_semi").select("component", row.alias("i"), each("columns").alias("j"), F.lit(False).alias("second"), "node", "part", "digest", "shingles")
    right = all_of.select("component", each("rows").alias("i"), column.alias("j"), F.lit(True).alias("second"), "node", "part", "digest", "shingles")
    return found.unionByName(left.unionByName(right).groupBy("component", "i", "j").applyInPandas(compare, LINK))


def _sets(rows: DataFrame, shingle: int) -> DataFrame:
    """Members with their full sets, as packed 64-bit hashes; rows whose set has another digest (a repeated id) go."""

    @python_task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, packed = [], []
            for k, (digest, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(4).to_pylist())):
                data = shingle_set(words_of(text), shingle).tobytes()
                if hashlib.blake2b(data, digest_size=16).digest() == digest:
                    kept.append(k)
                    packed.append(data)
            some = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*some.columns[:4], pa.array(packed, pa.binary())], ["node", "digest", "component", "size", "shingles"])

    return rows.select("node", "digest", "component", "size", "text").mapInArrow(run, "node long, digest binary, component long, size long, shingles binary")
