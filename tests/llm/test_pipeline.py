import brute
import corpus_pipeline
import public_tokenizers as P
import pytest
import tiktoken

from veilspark.llm import bpe, langid


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], sf_dir).persist())
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_each_stage_against_brute_force(spark, sf_dir, stages):
    docs, known, unrepeated, apart, clean, encoded = stages
    model = langid.fit(docs, langid.F.lit(True))
    assert texts(known) == {i: t for i, t in texts(docs).items() if not model.predict(t)[2]}
    assert texts(unrepeated) == {i: t for i, t in brute.line_dedup(list(texts(known).items())).items() if brute.words(t)}
    components = brute.near_duplicates(list(texts(unrepeated).items()))
    assert texts(apart) == {i: t for i, t in texts(unrepeated).items() if components[i][1] == i}
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    hits = brute.decontamination(list(texts(apart).items()), items)
    after = texts(clean)
    assert set(after) == {i for i, h in hits.items() if not h[4]}
    assert all(after[i] == t for i, t in texts(apart).items() if i in after and hits[i][1] == 0)
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(f.read()), special_tokens={})
    assert {r["doc_id"]: r["n_tokens"] for r in encoded.collect()} == {i: len(reference.encode_ordinary(t)) for i, t in after.items()}


def test_columns(stages):
    assert all(df.columns == stages[0].columns and df.schema == stages[0].schema for df in stages[1:-1])
    assert all(r["n_chars"] == len(r["text"]) for r in stages[-2].collect())


def test_run_equals_stages(spark, sf_dir, stages):
    assert sorted(corpus_pipeline.run(spark, sf_dir).collect()) == sorted(stages[-1].collect())


def test_odd_rows(spark, sf_dir):
    words = " ".join(f"le{i} the" for i in range(40))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, words, "en", "s", 1), (3, words + " more", "en", None, 1), (4, "x y z " * 30000, "en", "s", 1), (5, "new words here", "en", "s", 1), (5, "new words here", "en", "s", 1)]
    docs = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, node string")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), sf_dir)
        assert empty.count() == 0
        docs = stage(spark, docs, sf_dir)
    assert sorted((r["doc_id"] or 0) for r in docs.collect()) == [0, 4, 5]


def test_near_dedup_keeps_all_texts_of_an_id(spark, sf_dir):
    a, b, c = (" ".join(f"{x}{n}" for n in range(30)) for x in "abc")
    rows = [(1, a, "z"), (1, b, "y"), (1, a, "x"), (2, b, "w"), (3, c, "v"), (None, c, "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = sorted((r["doc_id"] or 0, r["text"][0], r["source"]) for r in corpus_pipeline.near_dedup(spark, docs, sf_dir).collect())
    assert kept == [(0, "c", "u"), (1, "a", "x"), (1, "b", "y"), (3, "c", "v")]
