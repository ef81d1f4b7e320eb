import random
import time

import brute
from veilspark.llm import linededup


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_random_edits_against_all_pairs(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(6)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randrange(6, 13))] for _ in range(12)]
    rows = []
    for doc in range(60):
        lines = []
        for _ in range(rng.randrange(1, 7)):
            line = list(rng.choice(base))
            for _ in range(rng.randrange(3)):
                at, kind = rng.randrange(len(line)), rng.randrange(3)
                line[at : at + (kind > 0)] = [rng.choice(vocabulary)] if kind < 2 else []
            lines.append(rng.choice([" ", "  ", "\t"]).join(line))
        rows.append((doc * 7 % 60, "\n".join(lines) + rng.choice(["", "\n", "\n\n", "\r\nend"])))
    expected = brute.line_dedup(rows)
    got = texts(linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == {i: t for i, t in expected.items() if brute.words(t)}
    report = linededup.report(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["kept_chars"] for r in report.collect()} == {i: len(t) for i, t in expected.items()}


def test_edge_rows(spark):
    same = "one two three four five six seven eight"
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, same), (4, same), (5, same + " nine"), (6, "x\n" + same.replace("four", "for") + "\ny"), (7, "x"), (7, "x"), (8, "own\nx"), (8, "other\nx"), (9, "word " * 30000), (10, "word " * 29999)]
    df = spark.createDataFrame([(*r, n, "t") for n, r in enumerate(rows)], "doc_id long, text string, linededup int, th string")
    out = linededup.dedup(df)
    assert out.columns == df.columns
    got = sorted((r["doc_id"] or 0, r["text"] or "", r["linededup"]) for r in out.collect())
    assert got == sorted([(1, "", 0), (2, "", 1), (3, " \n\t", 2), (0, same, 3), (6, "x\ny", 6), (8, "own", 9), (8, "other", 10), (9, "word " * 30000, 11)])
    assert linededup.dedup(df.limit(0)).count() == 0


def test_rows_without_id_and_with_one_id(spark):
    line = "one two three four five six seven eight"
    rows = [(None, f"{line}\nown {n}") for n in range(6)] + [(3, line), (3, line + "\nx"), (3, line)]
    got = sorted((r["doc_id"] or 0, r["text"]) for r in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    # one of the rows without an id keeps the line; rows with one id and text are one document
    owns = [t for i, t in got if i == 0]
    assert sorted(t.replace(line + "\n", "") for t in owns) == [f"own {n}" for n in range(6)] and sum(line in t for t in owns) == 1
    assert [t for i, t in got if i == 3] == ["x"]
    text_ids = [(str(i) if i is not None else None, t) for i, t in rows]
    assert sorted((int(r["doc_id"] or 0), r["text"]) for r in linededup.dedup(spark.createDataFrame(text_ids, "doc_id string, text string")).collect()) == got


def test_very_long_lines_take_linear_time(spark):
    words = [f"w{n % 5000}x{n}" for n in range(200_000)]
    other = [*words[:100_000], "other", *words[100_001:]]
    rows = [(1, " ".join(words)), (2, "kept\n" + " ".join(other)), (3, " ".join(words[:-2]))]
    began = time.time()
    got = texts(linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == {1: rows[0][1], 2: "kept", 3: rows[2][1]}
    assert time.time() - began < 60


def test_many_lines_of_one_document(spark):
    lines = [f"line {n % 4000} of a long document with words" for n in range(30_000)]
    got = texts(linededup.dedup(spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(lines[:50]) + "\nend")], "doc_id long, text string")))
    assert got[2] == "end" and got[1] == brute.line_dedup([(1, "\n".join(lines[:4000]))])[1]


def test_native_plan(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")
    plan = linededup.dedup(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
