import hashlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from veilspark.llm import bpe, queries

with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
    RANKS = bpe.read_ranks(f.read())
REFERENCE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
MERGES = bpe.Merges(RANKS)
CODEC = bpe.Codec(MERGES, P.PATTERN)
TEXTS = st.text(st.one_of(st.sampled_from(" \n\t\x1c\x85\xa0'sthe re=-_09.,"), st.characters(blacklist_categories=("Cs",))), max_size=80)


def test_pattern_is_the_one_that_can_be_cut():
    assert P.PATTERN == bpe.CUT_PATTERN and CODEC.cuts


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_like_tiktoken(text):
    ids = CODEC.encode(text)
    assert ids == REFERENCE.encode_ordinary(text)
    assert "".join(CODEC.decode_stream(ids, chunk=1)) == text
    assert MERGES.well_formed(np.array(ids, np.int64))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(TEXTS, st.none()), max_size=12))
def test_batches_like_tiktoken(texts):
    ids, count = CODEC.encode_all(pa.array(texts, pa.string()))
    expected = [REFERENCE.encode_ordinary(t or "") for t in texts]
    assert count.tolist() == list(map(len, expected)) and ids.tolist() == [i for e in expected for i in e]


def test_other_vocabularies():
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        multi = bpe.read_ranks(f.read())
    spaces = RANKS | {b"  ": 50256, b"\n ": 50257, b" \n": 50258}  # tokens of white space; merging leads to the first
    odd = RANKS | {b"qzxjq": 50256}  # a token that merging never leads to
    texts = ["a  ", "a   ", "  ", " \n ", "x \n y", "a  b", "qzxjq", " qzxjq", "aqzxjqb", "汉字和 кириллица  ünï", "tail \t"]
    for ranks in (multi, spaces, odd):
        reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        codec = bpe.Codec(bpe.Merges(ranks), P.PATTERN)
        for text in texts:
            assert codec.encode(text) == reference.encode_ordinary(text), text


def test_other_patterns_are_not_cut():
    pattern = r"\p{L}+ \p{L}+|\s+|[^\s]+"
    reference = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=RANKS, special_tokens={})
    codec = bpe.Codec(MERGES, pattern)
    for text in ("two words here now", "a  b", "", "x"):
        assert codec.encode(text) == reference.encode_ordinary(text)


def test_long_runs_and_small_tables():
    small = bpe.Codec(MERGES, P.PATTERN, memo=10)
    small.transducer = bpe.Transducer(MERGES, max_states=40, max_pairs=30)
    for text in ("a" * 3000, "=" * 2500, " " * 400, "ab" * 2000, "<|endoftext|>", "x" + "é" * 900, "漢字" * 700):
        assert CODEC.encode(text) == REFERENCE.encode_ordinary(text)
        assert small.encode(text) == REFERENCE.encode_ordinary(text)
        pieces = [p.encode() for p in small.find(text)]
        assert [i for p in pieces for i in small.transducer.encode(p)] == REFERENCE.encode_ordinary(text)
        assert small.transducer.encode_all(pieces, group=2, step_bound=5)[0].tolist() == REFERENCE.encode_ordinary(text)


def test_stay_apart_against_encoding_the_joined_bytes():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 50256, 3000), rng.integers(0, 50256, 3000)
    words = {t: i for t, i in RANKS.items() if t.isalpha() and len(t) < 4}
    some = np.array(list(words.values()))
    a[:2000], b[:2000] = rng.choice(some, 2000), rng.choice(some, 2000)
    by_id = {i: t for t, i in RANKS.items()}

    def merged(data):  # the lowest-ranked pair first
        parts = [data[i : i + 1] for i in range(len(data))]
        while ranked := [(RANKS[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in RANKS]:
            at = min(ranked)[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [RANKS[p] for p in parts]

    reachable = (MERGES.left[a] >= 0) & (MERGES.left[b] >= 0)
    a, b = a[reachable], b[reachable]
    assert MERGES.stay_apart(a, b).tolist() == [merged(by_id[x] + by_id[y]) == [x, y] for x, y in zip(a.tolist(), b.tolist())]


def test_utf8_stream_splits_characters():
    data = "aé漢🙂".encode()
    for step in (1, 2, 3):
        stream = bpe.Utf8Stream()
        assert "".join(stream.feed(data[i : i + step]) for i in range(0, len(data), step)) + stream.finish() == "aé漢🙂"
    stream = bpe.Utf8Stream()
    assert stream.feed(b"\xf0\x9f") == "" and stream.finish() == "\ufffd"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.binary(max_size=6), st.sampled_from([b"a", "é漢🙂".encode(), b"\xe2\x82", b"\xf0\x9f\x99", b"\xed\xa0\x80", b"\xc0\xaf"])), max_size=8))
def test_utf8_stream_on_ill_formed_bytes(chunks):
    stream = bpe.Utf8Stream()
    assert "".join(map(stream.feed, chunks)) + stream.finish() == b"".join(chunks).decode("utf-8", "replace")
    ids = np.array([RANKS[bytes([x])] for x in b"".join(chunks)], np.int64)
    try:
        b"".join(chunks).decode("utf-8")
        assert MERGES.well_formed(ids)
    except UnicodeDecodeError:
        assert not MERGES.well_formed(ids)
    assert "".join(CODEC.decode_stream(ids, chunk=3)) == b"".join(chunks).decode("utf-8", "replace")


def digest(text):
    ids = REFERENCE.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_query(spark, sf_dir):
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    out = queries.op2_byte_bpe(spark, sf_dir)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {r[0]: tuple(r)[1:] for r in out.collect()} == {i: digest(t) for i, t in texts.items()}


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "a  b\n\n c"), (None, "x"), (3, "a  b\n\n c"), (4, "long word " * 20000)]
    df = spark.createDataFrame([(*r, 0, "z") for r in rows], "doc_id long, text string, n_tokens int, token_ids string")
    out = bpe.encode_decode(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert [tuple(r) for r in out.collect()] == [(i, *digest(t)) for i, t in rows]
    small = bpe.encode_decode(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, memo=5, max_states=30)
    assert small.collect() == out.collect()
    counts = bpe.token_counts(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert [(r["doc_id"], r["n_tokens"]) for r in counts.collect()] == [(i, digest(t)[0]) for i, t in rows] and "text" not in counts.columns
    ids = bpe.encode_ids(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    back = bpe.decode_ids(ids, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert [r["decoded"] for r in back.collect()] == [t or "" for _, t in rows]
    assert bpe.encode_decode(df.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
