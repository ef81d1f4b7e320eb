"""Operator 3: URL filters by association rules.

A list of host-and-path rules judges what it covers, the longest rule first. Its verdicts label those URLs, unless the
table has a column of labels; over the labelled token sets Spark's FP-growth mines which token combinations go with a verdict. Rules below the support or
confidence bound go, and so do rules that a part of their tokens already implies as surely. An inverted index
from token to rules finds the rules whose tokens all occur in a URL; the surest one decides, and ``default``
where none does.

Null URLs and URLs without ``://`` have empty host and path and no tokens: the default. Rows are judged one by
one, so ties, repeated rows and further columns have no effect; rows with a null label teach nothing, and with no
labelled URL nothing is mined. Of rules that fire, the one with the higher confidence decides, then support, then fewer
tokens, then the tokens' order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import python_task

#: (host, path, verdict)
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LABEL = "verdict="


def rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(rest(url), r"^[^/?#]*", 0), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def listed(rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits columns host and path, as a struct; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column) -> Column:
    """Distinct tokens: scheme, labels of the host, all parts of the path (digits as #), ending,
    query keys and key=value pairs (digits as #), whether there is a fragment, and its text (digits as #)."""
    digits = lambda c: F.regexp_replace(c, r"[0-9]+", "#")
    tagged = lambda tag, items: F.transform(F.filter(items, lambda x: x != ""), lambda x: F.concat(F.lit(tag), x))
    query = F.regexp_extract(rest(url), r"^[^?#]*\?([^#]*)", 1)
    fragment = F.regexp_extract(rest(url), r"#([\s\S]*)", 1)
    parts = F.array(
        F.concat(F.lit("s:"), F.lower(F.regexp_extract(url, r"^[A-Za-z]+", 0))),
        F.when(rest(url).contains("#"), F.lit("f:#")).otherwise(F.lit("f:")),
        F.concat(F.lit("e:"), F.regexp_extract(F.col("path"), r"\.([A-Za-z0-9]+)$", 1)),
    )
    found = F.concat(parts, tagged("h:", F.split(digits(F.col("host")), r"\.")), tagged("p:", F.split(digits(F.col("path")), "/")), tagged("q:", F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))), tagged("v:", F.filter(F.split(digits(query), "&"), lambda x: x.contains("="))), tagged("t:", F.array(digits(fragment))))
    return F.when(F.instr(url, "://") > 0, F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def mine(labelled: DataFrame, support: float = 0.01, confidence: float = 0.8) -> list[tuple[frozenset, str, float, float]]:
    """(tokens, verdict, confidence, support), surest first, from rows (tokens, verdict).

    Every frequent token set has at least ``support`` of the rows, which bounds their number whatever the input's size.
    """
    baskets = labelled.select(F.array_union("tokens", F.array(F.concat(F.lit(LABEL), "verdict"))).alias("items"))
    if baskets.isEmpty():
        return []
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    label = F.element_at("consequent", 1)
    rows = model.associationRules.where(label.startswith(LABEL) & ~F.exists("antecedent", lambda x: x.startswith(LABEL))).select("antecedent", label.alias("verdict"), "confidence", "support")
    found = [(frozenset(r["antecedent"]), r["verdict"][len(LABEL) :], r["confidence"], r["support"]) for r in rows.toLocalIterator()]
    return pruned(found)


def pruned(rules: list[tuple[frozenset, str, float, float]]) -> list[tuple[frozenset, str, float, float]]:
    """Without rules that have a part with the same verdict and at least the same confidence; surest first.

    The surest part of a set is found from its parts with one token less, once for each set, and all these are frequent.
    """
    sure = {(tokens, verdict): c for tokens, verdict, c, _ in rules}
    best: dict[tuple[frozenset, str], float] = {}

    def surest(tokens: frozenset, verdict: str) -> float:
        """The highest confidence of a rule with some or all of these tokens."""
        known = best.get((tokens, verdict))
        if known is None:
            known = best[tokens, verdict] = max([sure.get((tokens, verdict), -1.0), *(surest(tokens - {t}, verdict) for t in tokens if len(tokens) > 1)])
        return known

    kept = [r for r in rules if all(surest(r[0] - {t}, r[1]) < r[2] for t in r[0] if len(r[0]) > 1)]
    return sorted(kept, key=lambda r: (-r[2], -r[3], len(r[0]), sorted(r[0]), r[1]))


class Index:
    """token -> rules that need it; a rule fires when as many of its tokens have been met as it has."""

    def __init__(self, rules: list[tuple[frozenset, str, float, float]]):
        self.needs, self.verdicts = [len(r[0]) for r in rules], [r[1] for r in rules]
        self.rules_of: dict[str, list[int]] = {}
        for n, rule in enumerate(rules):
            for token in rule[0]:
                self.rules_of.setdefault(token, []).append(n)

    def best(self, tokens: list[str]) -> int | None:
        met: dict[int, int] = {}
        for token in tokens:
            for n in self.rules_of.get(token, ()):
                met[n] = met.get(n, 0) + 1
        return min((n for n, count in met.items() if count == self.needs[n]), default=None)


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, support: float = 0.01, confidence: float = 0.8, default: str = "allow", shard: int = 20_000, id_col: str = "page_id", url_col: str = "url", label_col: str | None = None) -> DataFrame:
    """A row for each page: id, host, path, rule, verdict, mined (the mined rule that decided, or null).

    Mined rules are shipped ``shard`` at a time, surest first; a row that one shard has judged passes the others.
    """
    label = F.lit(None).cast("string") if label_col is None else F.col(label_col).cast("string")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), label.alias("label")).withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url"))).withColumn("hit", listed(rules)).withColumn("tokens", tokens(F.col("url")))
    rows = rows.select("id", "host", "path", F.col("hit.rule").alias("rule"), F.col("hit.verdict").alias("verdict"), F.lit(None).cast("string").alias("mined"), "tokens", "label")
    taught = F.col("verdict") if label_col is None else F.col("label")
    mined = mine(rows.where(taught.isNotNull()).select("tokens", taught.alias("verdict")), support, confidence)
    rows = rows.drop("label")
    schema = rows.schema
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
    for at in range(0, len(mined), shard):
        part = mined[at : at + shard]

        @python_task
        def run(batches: Iterator[pa.RecordBatch], part=part) -> Iterator[pa.RecordBatch]:
            index = Index(part)
            for batch in batches:
                verdicts, why = batch.column(4).to_pylist(), batch.column(5).to_pylist()
                for n, found in enumerate(batch.column(6).to_pylist()):
                    if verdicts[n] is None:
                        best = index.best(found)
                        if best is not None:
                            verdicts[n], why[n] = part[best][1], " ".join(sorted(part[best][0]))
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(verdicts, pa.string()), pa.array(why, pa.string()), batch.column(6)], batch.schema.names)

        rows = rows.mapInArrow(run, schema)
    return rows.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"), "mined")
