"""Operator 5: line dedup by a deletion-neighbourhood join, with DataFrame functions only.

Lines are compared by their words ``[^\\x20\\x09-\\x0D]+``. Of equal lines the earliest occurrence, by (doc_id,
text hash, position), stays. A line of at least ``least_words`` words also goes if an earlier line of as many words
lies within one inserted, deleted or replaced word; the earlier line counts whether or not it stays itself, so the
result does not depend on the order of work.

The neighbourhood of a line is the line and all variants with one word deleted. Two lines are within the bound
exactly if they have equal variants from the same place (a replaced word), or one equals a variant of the other
(an added word). Within one edit the words before or after the middle are equal, so lines are first matched by
their halves, and a variant is made only where the other half is shared; no pair is lost by that. Variants are
hashed from running sums of word hashes: one ordered pass over a line's words, however long it is. Groups of equal
variants are reduced to their earliest members by partial minima, and each line is checked against its earliest
partner word by word; no pairs are formed within a group.

Null and empty texts, and lines without words, stay as they are. Rows with the same id and text are one document;
rows with the same id and other texts, or without an id, are told apart and ordered by the text's hash. A null id
comes first. An empty table gives an empty one; further columns, of any name, are carried along.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import joinable, scratch, shared_dir, shuffle_partitions, written

NEW = "linededup_"
SPACES = ("\t", "\u000b", "\u000c", "\r", "  ")
#: Bits of a line's halves that another line shares: words before and after the middle, for partners of as many
#: words or one more, and for partners of one word less.
BEFORE, AFTER, BEFORE_LESS, AFTER_LESS = 1, 2, 4, 8


def normal(line: Column) -> Column:
    """Words joined by one space. Only lines with other white space go through the regular expression."""
    odd = reduce(lambda a, b: a | b, (F.contains(line, F.lit(s)) for s in SPACES))
    return F.trim(F.when(odd, F.regexp_replace(line, "[\\x20\\x09-\\x0D]+", " ")).otherwise(line))


def half_keys(words: Column, n: Column, least_words: int) -> list[Column]:
    """Hashes of the two halves, in the order of their bits; null where no partner can be that long."""
    def keys(base: Column) -> list[Column]:
        half = F.floor(base / 2).cast("int")
        return [F.xxhash64(F.lit(0), base, F.slice(words, F.lit(1), half)), F.xxhash64(F.lit(1), base, F.slice(words, n - (base - half) + 1, base - half))]

    own, less = keys(n), keys(n - 1)
    return [*(F.when(n >= least_words, k) for k in own), *(F.when(n > least_words, k) for k in less)]


def keyed_lines(docs: DataFrame, least_words: int, id_col: str, text_col: str) -> DataFrame:
    """(doc, th, pos, h1, h2, k0..k3) of every line with a word; th is the hash of the document's text."""
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.col(text_col)).alias("th"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("pos", "line"))
    rows = rows.where(F.btrim("line", F.lit(" \t\u000b\u000c\r")) != "").select("doc", "th", "pos", normal(F.col("line")).alias("norm"))
    rows = rows.select("doc", "th", "pos", F.xxhash64("norm").alias("h1"), F.xxhash64(F.lit(1), F.col("norm")).alias("h2"), F.split("norm", " ").alias("words"))
    rows = rows.select("*", *(k.alias(f"k{i}") for i, k in enumerate(half_keys(F.col("words"), F.size("words"), least_words))))
    return rows.drop("words")


def decisions(docs: DataFrame, least_words: int, id_col: str, text_col: str) -> DataFrame:
    """(doc, th, pos, near) of every line that goes."""
    lines = written(keyed_lines(docs, least_words, id_col, text_col), "lines")
    keys = [f"k{i}" for i in range(4)]
    distinct = lines.groupBy("h1", "h2").agg(F.count("*").alias("c"), *(F.min(x).alias(x) for x in ("doc", "th", "pos", *keys)))
    distinct = written(distinct, "lines-distinct")  # doc, th, pos are one place only where c = 1
    again = distinct.where("c > 1").select("h1", "h2")
    places = lines.select("doc", "th", "pos", "h1", "h2")
    repeated = written(places.join(joinable(again), ["h1", "h2"]), "lines-repeated")
    firsts = written(repeated.groupBy("h1", "h2").agg(F.min(F.struct("doc", "th", "pos")).alias("first")), "lines-firsts")
    firsts = joinable(firsts)
    near = _near(docs, distinct, firsts, id_col, text_col)
    near = joinable(near)

    exact = repeated.join(firsts, ["h1", "h2"]).where(~F.struct("doc", "th", "pos").eqNullSafe(F.col("first"))).join(near, ["h1", "h2"], "left_anti")
    gone = places.join(near, ["h1", "h2"]).select("doc", "th", "pos", F.lit(True).alias("near"))
    return gone.unionByName(exact.select("doc", "th", "pos", F.lit(False).alias("near")))


def _near(docs: DataFrame, distinct: DataFrame, firsts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(h1, h2) of the lines that have an earlier one within one edit."""
    half = distinct.where("k0 is not null").select("h1", "h2", F.posexplode(F.array("k0", "k1", "k2", "k3")).alias("kind", "k")).where("k is not null")
    shared = half.groupBy("k").agg(F.min("h1").alias("a"), F.max("h1").alias("z")).where("a <> z").select("k")
    bits = half.join(shared, "k", "left_semi").groupBy("h1", "h2").agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("kind"))).alias("bits"))
    live = bits.join(distinct.select("h1", "h2", "doc", "th", "pos"), ["h1", "h2"]).join(firsts, ["h1", "h2"], "left")
    live = live.select("h1", "h2", "bits", F.coalesce("first", F.struct("doc", "th", "pos")).alias("first"))
    # numbers in the order of the places, so that the earliest line is the least number
    live = written(live.orderBy("first").select("h1", "h2", "bits", "first", F.monotonically_increasing_id().alias("line")), "lines-live")

    spots = live.groupBy(F.col("first.doc").alias("doc"), F.col("first.th").alias("th")).agg(F.collect_list(F.struct("line", "bits", "first.pos")).alias("at"))  # lines of one document
    wanted = joinable(spots)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(wanted, F.col("id").eqNullSafe(F.col("doc")) & (F.xxhash64("t") == F.col("th")))
    split = F.transform(F.array(F.split("t", "\n", -1)), lambda rows: F.transform("at", lambda a: F.struct(a["line"].alias("line"), a["bits"].alias("bits"), F.get(rows, a["pos"]).alias("text"))))
    own = texts.select(F.explode(F.flatten(split)).alias("x")).select("x.line", "x.bits", F.split(normal(F.col("x.text")), " ").alias("words"))
    own = written(own.dropDuplicates(["line"]), "lines-words")  # a repeated row repeats its lines

    members = written(_variants(own), "lines-variants")
    # the earliest and latest line of each variant from each place; of each variant, the earliest whole and shortened line
    place = written(members.groupBy("v", "i").agg(F.min("line").alias("least"), F.max("line").alias("most")), "lines-places")
    groups = place.groupBy("v").agg(F.min(F.when(F.col("i") < 0, F.col("least"))).alias("whole"), F.min(F.when(F.col("i") >= 0, F.col("least"))).alias("cut"), F.min("least").alias("a"), F.max("most").alias("z"))
    groups = written(groups.where("a <> z").select("v", "whole", "cut"), "lines-groups")
    met = members.join(joinable(groups), "v")
    ties = place.where("i >= 0 and least <> most").select("v", "i", "least")
    replaced = met.where("i >= 0").join(joinable(ties), ["v", "i"]).where("least < line").select("line", F.col("least").alias("partner"))
    added = met.select("line", F.when(F.col("i") < 0, F.col("cut")).otherwise(F.col("whole")).alias("partner")).where("partner < line")
    pairs = written(replaced.unionByName(added).groupBy("line").agg(F.min("partner").alias("partner")), "lines-pairs")

    some = own.select("line", "words").join(joinable(pairs.select("line").union(pairs.select("partner")).distinct()), "line", "left_semi")
    checked = pairs.join(some.select("line", F.col("words").alias("a")), "line").join(some.select(F.col("line").alias("partner"), F.col("words").alias("b")), "partner")
    close = written(checked.where(within_one("a", "b")).select("line"), "lines-close")
    return written(live.select("h1", "h2", "line").join(joinable(close), "line", "left_semi").select("h1", "h2"), "lines-near")


def _variants(own: DataFrame) -> DataFrame:
    """(line, i, v): the hash of each line without its word i, for the places that its shared halves leave, and of the
    whole line (i = -1). A hash sums the words' hashes by place, in two halves of 32 bits; a word after the deleted
    one counts at the place before its own."""
    n, has = F.size("words"), lambda bits: F.col("bits").bitwiseAND(F.lit(bits)) != 0
    middle, middle_less = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    begin = F.when(has(AFTER | AFTER_LESS), F.lit(0)).otherwise(F.when(has(BEFORE_LESS), middle_less).otherwise(middle))
    end = F.when(has(BEFORE | BEFORE_LESS), n).otherwise(F.least(n, F.when(has(AFTER), middle).otherwise(middle_less) + 1))
    low, high = lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF)), lambda h: F.shiftrightunsigned(h, 32)
    total = lambda hashes, part: F.aggregate(hashes, F.lit(0).cast("long"), lambda s, h: s + part(h))
    own = own.repartition(shuffle_partitions(own), "line").select("line", "words", n.alias("n"), begin.alias("begin"), end.alias("end"))
    here = F.transform("words", lambda w, j: F.xxhash64(w, j))
    moved = F.transform("words", lambda w, j: F.xxhash64(w, F.when(j < F.col("begin"), j).otherwise(j - 1)))  # without the word before ``begin``
    sums = own.select("line", "words", "n", "begin", "end", *(total(h, part).alias(name) for name, h, part in (("wl", here, low), ("wh", here, high), ("ml", moved, low), ("mh", moved, high))))
    places = F.concat(F.slice("words", F.col("begin") + 1, F.col("end") - F.col("begin")), F.array(F.lit(None).cast("string")))  # the null stands for the whole line
    word = sums.select("line", "n", "wl", "wh", "ml", "mh", "begin", F.posexplode(places).alias("p", "word")).withColumn("i", F.col("begin") + F.col("p"))
    a, b = F.xxhash64("word", "i"), F.xxhash64("word", F.col("i") - 1)
    word = word.select("line", "i", "n", "wl", "wh", "ml", "mh", F.isnull("word").alias("all"), low(a).alias("al"), high(a).alias("ah"), (low(a) - low(b)).alias("dl"), (high(a) - high(b)).alias("dh"))
    upto = Window.partitionBy("line").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x, y = F.col("ml") + F.sum("dl").over(upto) - F.col("al"), F.col("mh") + F.sum("dh").over(upto) - F.col("ah")
    m, x, y = (F.when(F.col("all"), w).otherwise(c) for w, c in ((F.col("n"), F.col("n") - 1), (F.col("wl"), x), (F.col("wh"), y)))
    return word.select("line", F.when(F.col("all"), F.lit(-1)).otherwise(F.col("i")).alias("i"), m.alias("m"), x.alias("x"), y.alias("y")).select("line", "i", F.xxhash64("m", "x", "y").alias("v"))


def within_one(a: str, b: str) -> Column:
    """Edit distance of two word lists is at most one: equal words from the front and from the back meet."""
    def equal(x: Column, y: Column) -> Column:
        miss = F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), False)
        return F.when(miss == 0, F.least(F.size(x), F.size(y)).cast("long")).otherwise(miss - 1)

    x, y = F.col(a), F.col(b)
    return (F.abs(F.size(x) - F.size(y)) <= 1) & (equal(x, y) + equal(F.reverse(x), F.reverse(y)) >= F.greatest(F.size(x), F.size(y)) - 1)


def _marked(docs: DataFrame, least_words: int, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with bits of the lines that go, 64 to a number: ``linededup_exact`` and ``linededup_near`` (null: none)."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("pos", F.lit(64)))
    zero = F.lit(0).cast("long")
    with scratch(docs.sparkSession) as kept:  # the tables on the way go
        gone = decisions(docs, least_words, id_col, text_col)
        kept.append(path := shared_dir(docs.sparkSession, "lines-gone"))
        words = gone.groupBy("doc", "th", F.floor(F.col("pos") / 64).cast("int").alias("w")).agg(F.bit_or(F.when(F.col("near"), zero).otherwise(bit)).alias("e"), F.bit_or(F.when(F.col("near"), bit).otherwise(zero)).alias("r"))
        words.write.parquet(path)
    words = docs.sparkSession.read.schema(words.schema).parquet(path)
    sparse = words.groupBy("doc", "th").agg(F.max("w").alias("last"), *(F.map_from_entries(F.collect_list(F.struct("w", c))).alias(c) for c in ("e", "r")))
    dense = lambda c: F.transform(F.sequence(F.lit(0), F.col("last")), lambda w: F.coalesce(F.try_element_at(F.col(c), w), zero))
    per_doc = sparse.select(F.col("doc").alias(f"{NEW}doc"), F.col("th").alias(f"{NEW}th"), dense("e").alias(f"{NEW}exact"), dense("r").alias(f"{NEW}near"))
    per_doc = joinable(per_doc)
    return docs.join(per_doc, docs[id_col].eqNullSafe(F.col(f"{NEW}doc")) & (F.xxhash64(docs[text_col]) == F.col(f"{NEW}th")), "left")


def _kept_text(text: Column) -> Column:
    def stays(i: Column) -> Column:
        word = F.floor(i / 64).cast("int")
        bits = F.coalesce(F.get(f"{NEW}exact", word).bitwiseOR(F.get(f"{NEW}near", word)), F.lit(0).cast("long"))
        return F.call_function("shiftright", bits, F.pmod(i, F.lit(64))).bitwiseAND(F.lit(1).cast("long")) == 0

    return F.when(F.col(f"{NEW}th").isNull(), text).otherwise(F.array_join(F.filter(F.split(text, "\n", -1), lambda _, i: stays(i)), "\n"))


def dedup(docs: DataFrame, least_words: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the repeated lines; documents that had lines with words and have none left go as well."""
    clean = _marked(docs, least_words, id_col, text_col).withColumn(text_col, _kept_text(docs[text_col]))
    blank = F.btrim(F.col(text_col), F.lit(" \t\n\u000b\u000c\r")) == ""
    return clean.where(~F.coalesce(blank & F.col(f"{NEW}th").isNotNull(), F.lit(False))).select(*(f"`{c}`" for c in docs.columns))


def report(docs: DataFrame, least_words: int = 8) -> DataFrame:
    """A row for each document: doc_id, n_exact and n_near (lines that went), kept_chars, text_sha256 of what stays."""
    marked = _marked(docs.select("doc_id", "text"), least_words, "doc_id", "text")
    count = lambda c: F.coalesce(F.aggregate(c, F.lit(0).cast("long"), lambda s, bits: s + F.bit_count(bits)), F.lit(0).cast("long"))
    kept = F.coalesce(_kept_text(F.col("text")), F.lit(""))
    return marked.select("doc_id", count(f"{NEW}exact").alias("n_exact"), count(f"{NEW}near").alias("n_near"), kept.alias("kept")).select("doc_id", "n_exact", "n_near", F.length("kept").cast("long").alias("kept_chars"), F.sha2("kept", 256).alias("text_sha256"))
