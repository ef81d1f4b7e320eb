
import random

from veilspark.llm import crf, langid, rollup, urls
from veilspark.llm.common import shared_dir

UNLEARNED = [
    "w szczebrzeszynie chrząszcz brzmi w trzcinie i szczebrzeszyn z tego słynie że jest bardzo ładny",
    "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto",
    "tutti gli esseri umani nascono liberi ed eguali in dignità e diritti essi sono dotati di ragione e di coscienza",
    "все люди рождаются свободными и равными в своем достоинстве и правах они наделены разумом и совестью",
    "όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα",
]


def test_unlearned_languages_and_gibberish_are_rejected(spark, sf_dir):
    rng = random.Random(1)
    noise = [" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(3, 9))) for _ in range(40)) for letters in ("abcdefghijklmnopqrstuvwxyz", "qxzjkvwpb")]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.fit(docs, langid.F.lit(True))
    odd = spark.createDataFrame([(n, t) for n, t in enumerate(UNLEARNED + noise)], "doc_id long, text string")
    assert [r["rejected"] for r in langid.predict(odd, model).collect()] == [True] * 7
    # each bound alone is of use: neither lies near chance
    assert model.least_score > 1.2 / len(model.labels) and model.least_known > 0.8
    clean = [r["rejected"] for r in langid.predict(docs.where("text is not null"), model).collect()]
    assert sum(clean) <= 0.01 * len(clean)


def test_loose_signs_count_alike_at_every_length():
    pattern = ["#", "*", "&", "<>", "||", "|", "word", "a#"]
    for n in (3992, 4000, 4008, 40000):
        words = (pattern * (n // 8))[:n]
        features, _ = crf.sequence(" ".join(words))
        assert features.shape == (1, crf.N_FEATURES) and features[0, -1] == 6 / 8


def test_field_learns_from_all_lines_of_a_document(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(crf, "train", lambda sequences: seen.extend((len(f), label) for f, label in sequences))
    docs = spark.createDataFrame([(n, "\n".join(f"line {i} of it" for i in range(100 * n))) for n in range(1, 6)], "doc_id long, text string")
    labels = spark.createDataFrame([(n, n % 2, 0) for n in range(1, 6)], "doc_id long, quality int, toxic int")
    crf.fit(docs, labels)
    assert sorted(seen) == [(100, 0), (200, 1), (300, 0), (400, 1), (500, 0)]


def test_line_budget_does_not_depend_on_order():
    rng = random.Random(3)
    rows = [(rng.randrange(1000), str(n), n % 2, bytes(4 * crf.N_FEATURES * rng.randrange(0, 40))) for n in range(60)]
    expected, held = [], {0: 0, 1: 0}
    for row in sorted(rows):
        if held[row[2]] < 200:
            expected.append(row[1:])
        held[row[2]] += len(row[3]) // (4 * crf.N_FEATURES)
    for _ in range(5):
        rng.shuffle(rows)
        assert crf.within(200, iter(rows)) == sorted(expected)


def test_rules_are_mined_from_deep_path_parts_query_values_and_fragments(spark):
    rules = [("bad.net", "/", "block"), ("good.net", "/", "allow")]
    ends = [("a/b/c/d/e/f/casino", "a/b/c/d/e/f/garden"), ("x?topic=casino", "x?topic=garden"), ("x#casino", "x#garden")]
    for bad, good in ends:
        pages = [(n, f"http://{'bad' if n % 2 else 'good'}.net/{bad if n % 2 else good}") for n in range(40)] + [(100, f"http://x.net/{bad}"), (101, f"http://x.net/{good}")]
        out = {r["page_id"]: r["verdict"] for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string"), rules).collect()}
        assert (out[100], out[101]) == ("block", "allow")


def test_words_count_without_an_estimate(spark):
    docs = spark.createDataFrame([("s", "en", "three whole words", None), ("s", "en", "two words", 9), ("s", "de", None, None)], "source string, lang string, text string, n_chars long")
    totals = {tuple(r)[:3]: tuple(r)[3:] for r in rollup.maintain(docs, shared_dir(spark, "null-estimate")).collect()}
    assert totals == {("s", "en", "words/1"): (2, 5), ("s", "en", "chars/1"): (2, 26)}
