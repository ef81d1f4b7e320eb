import hashlib
import random

import brute
import pytest
from veilspark.llm import chat, queries, rollup, urls
from veilspark.llm.common import shared_dir


def test_url_query(spark, sf_dir):
    pages = {r[0]: r[1] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").collect()}
    out = {r["page_id"]: r for r in queries.op3_url_rules(spark, sf_dir).collect()}
    assert set(out) == set(pages)
    for i, url in pages.items():
        host, path = brute.url_parts(url)
        rule, verdict = brute.url_rule(host, path)
        assert (out[i]["host"], out[i]["path"], out[i]["rule"]) == (host, path, rule)
        assert not rule or (out[i]["verdict"], out[i]["mined"]) == (verdict, None)
    # the verdicts of the others by counting all subsets of the labelled pages' tokens
    parts = {i: (brute.url_tokens(u), brute.url_rule(*brute.url_parts(u))) for i, u in pages.items()}
    rules = brute.mined_rules([(t, v) for t, (rule, v) in parts.values() if rule], 0.01, 0.8)
    for i, (tokens, (rule, _)) in parts.items():
        if not rule:
            fired = next(((v, " ".join(sorted(t))) for t, v, _, _ in rules if t <= tokens), ("allow", None))
            assert (out[i]["verdict"], out[i]["mined"]) == fired


def test_labels_of_the_table_teach(spark):
    rows = [(n, f"http://{'a' if n % 3 else 'b'}.net/{'spam' if n % 2 else 'news'}/{n}", "block" if n % 2 else "allow" if n < 30 else None, "x") for n in range(40)]
    rows += [(100, "http://c.net/spam/x", None, "x"), (101, "http://c.net/news/x", None, "x"), (102, None, "block", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, label string, tokens string")
    out = {r["page_id"]: r["verdict"] for r in urls.judge(df, [], label_col="label").collect()}
    assert (out[100], out[101], out[102], out[38]) == ("block", "allow", "allow", "allow")
    assert len(out) == 43


URLS = [None, "", "no scheme", "http://", "http://org", "http://ORG/", "https://A.Example.ORG/es/x?y#z", "x://example.org/en/12", "x://badexample.org/es/", "x://e.com/fr", "x://e.com/fr/", "x://e.com/de/#f", "x://e.com?/de/", "x://u:p@h.com:80/de/", "://org/a", "a://b://org/"]


def test_url_edge_rows(spark):
    df = spark.createDataFrame([(n, u, "c") for n, u in enumerate(URLS + URLS[5:6])], "page_id long, url string, host string")
    for r in urls.judge(df).collect():
        u = (URLS + URLS[5:6])[r["page_id"]]
        host, path = brute.url_parts(u)
        rule, verdict = brute.url_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), u
        assert verdict is None or r["verdict"] == verdict
    assert urls.judge(df.limit(0)).count() == 0


def test_url_columns_that_clash(spark):
    rows = [(n, f"http://{'a' if n % 2 else 'b'}.com/{'de' if n % 2 else 'fr'}/x{n}", "c", "d", ["e"]) for n in range(30)] + [(99, "http://x.net/de/x1", "c", "d", ["e"])]
    clash = spark.createDataFrame(rows, "page_id long, url string, mined string, verdict string, tokens array<string>")
    plain = clash.select("page_id", "url")
    assert sorted(map(str, urls.judge(clash).collect())) == sorted(map(str, urls.judge(plain).collect()))


def test_mining_against_counting(spark):
    rng = random.Random(2)
    rows = [([t for t in "abcdef" if rng.random() < 0.5], rng.choice(["allow", "block"])) for _ in range(150)]
    rows += [(["a", "z"], "block")] * 40
    mined = urls.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.05, 0.7)
    expected = set()
    from itertools import combinations

    for n in range(1, 8):
        for c in combinations("abcdefz", n):
            for v in ("allow", "block"):
                have = [x for t, x in rows if set(c) <= set(t)]
                hit = sum(x == v for x in have)
                if have and hit >= 0.05 * len(rows) and hit >= 0.7 * len(have):
                    expected.add((frozenset(c), v, hit / len(have)))
    least = {(t, v) for t, v, c in expected if not any(u < t and w == v and d >= c for u, w, d in expected)}
    assert {(t, v) for t, v, _, _ in mined} == least and least


def test_shards_and_index():
    rules = [(frozenset("ab"), "block", 1.0, 0.1), (frozenset("c"), "allow", 0.9, 0.2)]
    index = urls.Index(rules)
    assert (index.best(["a", "c"]), index.best(["b", "a"]), index.best(["x"]), index.best([])) == (1, 0, None, None)


def test_url_shards_agree(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    assert sorted(map(str, urls.judge(pages, shard=3).collect())) == sorted(map(str, urls.judge(pages).collect()))


def test_escape_round_trip():
    rng = random.Random(1)
    t = chat.Template()
    for _ in range(500):
        turns = [(rng.choice(["user", "assistant", "", "a[INST]\\", "[/INST"]), "".join(rng.choice(["\\", "<", "[", "/", "<s>", "</s>", "[INST]", "[/INST]", "[ANSWER]", "INST]", "\\/s>", "x", "\n"]) for _ in range(rng.randrange(9)))) for _ in range(4)]
        text = "".join(p for role, body in turns for p, _ in t.segments(role, body))
        assert [(r, b) for r, b, _ in t.read(text)] == turns
        assert not any(c in t.escape(body) for _, body in turns for c in (*t.marks(), *t.guards))
    for marks in ({"end": "[INST]"}, {"end": "<[x"}, {"end": "</s\\>"}):  # twice the same; a mark's beginning within; a backslash
        with pytest.raises(ValueError):
            chat.Template(**marks)
    other = chat.Template("<|start|>", "<|text|>", "<|answer|>", "<|end|>")
    assert list(other.read("".join(p for p, _ in other.segments("assistant", "<|end|> \\")))) == [("assistant", "<|end|> \\", True)]


def test_registered_conversation_meets_the_marks(spark, sf_dir):
    row = queries.op8_chat_format(spark, sf_dir).where("conv_id = -7").first()
    assert tuple(row)[1:5] == expected_chat([("user", queries.TRICKY), ("assistant", queries.TRICKY)]) and row["valid"]
    assert queries.TRICKY not in chat.Template().escape(queries.TRICKY)


def expected_chat(turns):
    said = "".join(f"{r}\n{x}\n" for r, x in turns)
    loss = "".join(x for r, x in turns if r == "assistant")
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chat_long_conversation_and_edges(spark):
    rng = random.Random(6)
    rows = [(1, n, "user" if n % 2 == 0 else "assistant", f"t{n} </s> \\") for n in range(300)]
    rows += [(2, 0, "assistant", "early"), (2, 1, None, None), (None, 3, "user", "q"), (None, 4, "assistant", "a"), (3, None, "user", ""), (4, 0, "user", "x"), (4, 0, "user", "x"), (5, 0, "system", "s"), (5, 1, "user", "x" * 200000), (5, 2, "assistant", "é🙂")]
    order = sorted(rows, key=lambda r: (r[1] if r[1] is not None else -1, r[2] or "", r[3] or ""))
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, stretch string")
    out = {r["conv_id"]: r for r in chat.digests(chat.formatted(df, stretch=16)).collect()}
    for conv in {r[0] for r in rows}:
        assert tuple(out[conv])[1:5] == expected_chat([(r[2] or "", r[3] or "") for r in order if r[0] == conv])
    assert {c for c, r in out.items() if r["valid"]} == {1, None, 5}
    assert chat.digests(chat.formatted(df.limit(0))).count() == 0


def totals(r):
    return {tuple(x)[:3]: tuple(x)[3:] for x in r.totals().collect()}


def test_rollup_batches(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("a", "en", 5), ("a", "en", 7), (None, "de", 2), ("b", None, None)], "source string, lang string, n long")
    r = rollup.Rollup(spark, shared_dir(spark, "rollup-test"))
    assert totals(r) == {}
    assert r.commit("one", rollup.inserts(rows, F.col("n"), "v1"))
    assert not r.commit("one", rollup.inserts(rows, F.col("n"), "v1"))
    first = {("a", "en", "v1"): (2, 12), (None, "de", "v1"): (1, 2), ("b", None, "v1"): (1, 0)}
    assert totals(r) == first
    r.commit("two", rollup.revisions(rows, F.col("n"), F.col("n") * 2, "v1"))
    r.commit("three", rollup.deletes(rows.where("lang = 'de'"), F.lit(4), "v1"))
    r.commit("empty", rollup.inserts(rows.limit(0), F.col("n"), "v1"))
    after = {("a", "en", "v1"): (2, 24), ("b", None, "v1"): (1, 0)}
    assert totals(r) == after
    r.compact()
    assert totals(r) == after and not r.commit("two", rollup.inserts(rows, F.col("n"), "v1"))
    # a batch that broke off before its mark is written anew
    folder = r._folder("four")
    rollup.inserts(rows, F.col("n"), "v1").write.parquet(folder)
    r.fs.delete(r._path(f"{folder}/_SUCCESS"), True)
    assert totals(r) == after
    assert r.commit("four", rollup.inserts(rows, F.col("n"), "v2")) and totals(r)["a", "en", "v2"] == (2, 12)
    r.compact()
    r.compact()
    assert totals(r)["a", "en", "v2"] == (2, 12) and totals(r)["a", "en", "v1"] == (2, 24)


def test_word_count(spark):
    texts = [None, "", " ", "a", " a  b\n\tc\r", "x\x0by\x0cz", "é\u2028ü", "w " * 30000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(rollup.word_count(df["t"])).collect()] == [len(brute.words(t)) for t in texts]


def test_two_writers_of_one_batch(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("a", "en", 5)], "source string, lang string, n long")
    path = shared_dir(spark, "rollup-writers")
    one, two = rollup.Rollup(spark, path), rollup.Rollup(spark, path)
    two.committed = lambda batch: False  # both have looked before either has written
    assert one.commit("b", rollup.inserts(rows, F.col("n"), "v"))
    assert not two.commit("b", rollup.inserts(rows, F.col("n"), "v"))
    one.fs.mkdirs(one._path(f"{path}/_aside-left-behind"))
    assert totals(one) == {("a", "en", "v"): (1, 5)} == totals(two)


def test_rollup_of_a_tokenizer(spark, sf_dir):
    import public_tokenizers as P
    from pyspark.sql import functions as F

    from veilspark.llm import bpe

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = bpe.token_counts(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    r = rollup.Rollup(spark, shared_dir(spark, "rollup-bpe"))
    r.commit("all", rollup.inserts(counts, F.col("n_tokens"), "byte_bpe_50k/1"))
    encoded = {x["doc_id"]: x["n_tokens"] for x in queries.op2_byte_bpe(spark, sf_dir).collect()}
    assert sum(t for _, t in totals(r).values()) == sum(encoded.values()) and sum(n for n, _ in totals(r).values()) == len(encoded)
