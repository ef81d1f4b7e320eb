"""Operator 1: token counts as delta-maintained rollups.

A batch is a table of signed changes: inserts (+1), deletes (-1), and revised counts (old taken out, new put in).
It is summed by source, language and tokenizer version, and the sums - a few rows, however large the batch - are
stored under a name made from the batch's id. Totals are the sum over all committed batches. A batch is written
aside and renamed, so it is committed at once or not at all, and committing it again, after a failure or by mistake,
changes nothing; of two writers of one batch the first to rename wins. ``compact`` folds committed batches into one,
which remembers their ids.

Null source, language or version is a group of its own. A null count adds documents but no tokens. Repeated
change rows in one batch count each time: a change is given as often as it is meant. An empty batch commits and
changes nothing; groups that fall to zero documents and zero tokens are not listed.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

KEYS = ("source", "lang", "tokenizer")
SUMS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a whole text: places where a word begins. Null has none."""
    space = " \t\n\u000b\u000c\r"
    flat = F.translate(F.coalesce(text, F.lit("")), space, " " * len(space))
    return F.when(F.trim(flat) == "", F.lit(0)).otherwise(F.size(F.split(F.trim(flat), " +"))).cast("long")


def inserts(rows: DataFrame, tokens: Column, tokenizer: str) -> DataFrame:
    return rows.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(1).cast("long").alias("n_docs"), tokens.cast("long").alias("n_tokens"))


def deletes(rows: DataFrame, tokens: Column, tokenizer: str) -> DataFrame:
    return inserts(rows, -tokens, tokenizer).withColumn("n_docs", F.lit(-1).cast("long"))


def revisions(rows: DataFrame, old: Column, new: Column, tokenizer: str) -> DataFrame:
    return inserts(rows, new - old, tokenizer).withColumn("n_docs", F.lit(0).cast("long"))


class Rollup:
    """Totals kept in the folder ``path`` on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self.fs = hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _folder(self, batch: str) -> str:
        return f"{self.path}/batch-{hashlib.sha256(batch.encode()).hexdigest()[:32]}"

    def _done(self, folder: str) -> bool:
        return self.fs.exists(self._path(f"{folder}/_SUCCESS"))

    def _folders(self) -> list[str]:
        if not self.fs.exists(self._path(self.path)):
            return []
        return sorted(f for s in self.fs.listStatus(self._path(self.path)) if (f := str(s.getPath().toString())).rsplit("/", 1)[1].startswith(("batch-", "folded-")) and not f.endswith(".members") and self._done(f))

    def _folded(self) -> tuple[set[str], set[str]]:
        """(folders that a compaction has taken in, folders to read)."""
        folders = self._folders()
        name = lambda f: f.rsplit("/", 1)[1]
        taken = set()
        for folder in folders:
            if name(folder).startswith("folded-"):
                for row in self.spark.read.text(f"{folder}.members").collect():  # one short name a batch
                    taken |= set(json.loads(row[0]))
        return taken, {f for f in folders if name(f) not in taken}

    def committed(self, batch: str) -> bool:
        folder = self._folder(batch)
        return self._done(folder) or folder.rsplit("/", 1)[1] in self._folded()[0]

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds a batch; False, and nothing done, if it is there already."""
        if self.committed(batch):
            return False
        sums = changes.groupBy(*KEYS).agg(F.coalesce(F.sum("n_docs"), F.lit(0)).cast("long").alias("n_docs"), F.coalesce(F.sum("n_tokens"), F.lit(0)).cast("long").alias("n_tokens"))
        return self._publish(sums, self._folder(batch))

    def _publish(self, rows: DataFrame, folder: str) -> bool:
        """Writes aside, then renames; False if the folder has come to be meanwhile."""
        aside = f"_aside-{uuid.uuid4().hex}"  # readers pass over names with an underscore
        rows.write.parquet(f"{self.path}/{aside}")
        if self.fs.exists(self._path(folder)) and not self._done(folder):
            self.fs.delete(self._path(folder), True)  # broke off where renaming copies
        if not self._done(folder) and self.fs.rename(self._path(f"{self.path}/{aside}"), self._path(folder)) and not self.fs.exists(self._path(f"{folder}/{aside}")):
            return True
        for lost in (f"{self.path}/{aside}", f"{folder}/{aside}"):  # a rename onto a folder goes into it
            self.fs.delete(self._path(lost), True)
        return False

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens."""
        folders = sorted(self._folded()[1])
        rows = self.spark.read.schema(SUMS).parquet(*folders) if folders else self.spark.createDataFrame([], SUMS)
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> None:
        """One folder in place of all committed ones. The member list is written first, the sums' mark comes last."""
        taken, folders = self._folded()
        if len(folders) < 2:
            return
        members = sorted(taken | {f.rsplit("/", 1)[1] for f in folders})
        target = f"{self.path}/folded-{hashlib.sha256(json.dumps(members).encode()).hexdigest()[:32]}"
        self.spark.createDataFrame([(json.dumps(members),)], "value string").coalesce(1).write.mode("overwrite").text(f"{target}.members")
        self._publish(self.totals(), target)
        for folder in folders:
            self.fs.delete(self._path(folder), True)


def maintain(docs: DataFrame, path: str) -> DataFrame:
    """Totals of a document table through its life: inserted with estimated counts (n_chars / 4, rounded up; 0 if null), revised to
    counted words, blank documents deleted, counted anew under a second version (characters), one batch sent twice."""
    rollup = Rollup(docs.sparkSession, path)
    estimate = F.coalesce(F.ceil(F.col("n_chars") / 4).cast("long"), F.lit(0))
    rows = written(docs.select("source", "lang", estimate.alias("estimate"), word_count(F.col("text")).alias("words"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars")), "token-counts-rows")
    blank, words, chars = rows.where("words = 0"), F.col("words"), F.col("chars")
    rollup.commit("insert", inserts(rows, F.col("estimate"), "words/1"))
    rollup.commit("revise", revisions(rows, F.col("estimate"), words, "words/1"))
    rollup.commit("insert chars", inserts(rows, chars, "chars/1"))
    gone = deletes(blank, F.lit(0), "words/1").unionByName(deletes(blank, chars, "chars/1"))
    rollup.commit("delete", gone)
    rollup.commit("insert", inserts(rows, F.col("estimate"), "words/1"))
    rollup.compact()
    rollup.commit("delete", gone)
    return rollup.totals()
