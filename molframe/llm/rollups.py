"""Delta-maintained token counts by source, language and tokenizer version.

A batch holds changes: inserts, deletes and revised counts of documents. Each change becomes signed
amounts of additive measures (docs, tokens, bytes): +new for an insert, -old for a delete, and both for a
revision, under the old and the new keys. A batch is reduced to one signed row per key and written under
its batch id; the write is idempotent: a batch id that is already committed is left as it is, so a replay
after a lost driver or a repeated delivery changes nothing. Totals are the sums over the committed
batches, and `compact` folds batches into one base without changing them.

Everything is additive, so a hot source is summed within tasks before the shuffle, which moves one row
per key and task.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from molframe.llm import sentencepiece
from molframe.llm.common import shared_dir, table

KEYS = ["source", "lang", "tokenizer"]
MEASURES = ["docs", "tokens", "bytes"]
SCHEMA = T.StructType([*[T.StructField(k, T.StringType()) for k in KEYS], *[T.StructField(m, T.LongType()) for m in MEASURES]])

#: Tokenizer versions as expressions over a text: runs of non-blanks; those and the marks in them, each a token of its own; a token
#: for every four characters; the pieces of the SentencePiece encoder (None: counted by tasks, see `counts`).
VERSIONS = {
    "words-1": lambda t: F.size(F.filter(F.split(t, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")).cast("long"),
    "words-2": lambda t: VERSIONS["words-1"](t) + F.length(F.regexp_replace(t, "[^.,;:!?]", "")).cast("long"),
    "chars4-1": lambda t: F.ceil(F.char_length(t) / 4.0).cast("long"),
    "pieces-1": None,
}
PIECES = "pieces-1"


def counts(docs: DataFrame, versions: list[str], text_col: str = "text") -> DataFrame:
    """doc_id, source, lang, tokenizer, tokens, bytes: a row per document and version; null texts are empty, null keys stay null."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    size = F.octet_length(t).cast("long").alias("bytes")
    plain = [v for v in versions if v != PIECES]
    each = F.array(*[F.struct(F.lit(v).alias("tokenizer"), VERSIONS[v](t).alias("tokens")) for v in plain])
    out = docs.select("doc_id", "source", "lang", size, F.inline(each)) if plain else None
    if PIECES in versions:
        ids = sentencepiece.encode(docs.select(F.struct("doc_id", "source", "lang", size).alias("doc_id"), t.alias("text")))
        of = ids.select("doc_id.*", F.lit(PIECES).alias("tokenizer"), F.size("token_ids").cast("long").alias("tokens"))
        out = of if out is None else out.unionByName(of)
    return out


def without_last_word(t: Column) -> Column:
    """The text up to its last run of non-blanks, the same if it has none. Searched from the end, so a word of any length costs its length once."""
    blank = "[\\x20\\x09-\\x0D]"
    return F.regexp_replace(t, f"(?s)\\A(.*{blank})?[^\\x20\\x09-\\x0D]++{blank}*\\z", "$1")


def signed(rows: DataFrame, sign: int) -> DataFrame:
    """Rows of `counts` as signed amounts."""
    return rows.select(*KEYS, F.lit(sign).cast("long").alias("docs"), (F.col("tokens") * sign).alias("tokens"), (F.col("bytes") * sign).alias("bytes"))


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    return signed(old, -1).unionByName(signed(new, 1))


def reduced(amounts: DataFrame) -> DataFrame:
    """One row per key; keys whose amounts are all zero go. Null keys group together."""
    out = amounts.groupBy(*KEYS).agg(*[F.sum(m).cast("long").alias(m) for m in MEASURES])
    return out.where(" OR ".join(f"{m} <> 0" for m in MEASURES))


class Rollup:
    """Totals kept as committed batches under a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.folder}/{name}"))

    def _names(self, name: str) -> list[str]:
        """Finished writes under a folder."""
        if not self._exists(name):
            return []
        found = [x.getPath().getName() for x in self._fs.listStatus(self._path(f"{self.folder}/{name}"))]
        return sorted(x for x in found if self._exists(f"{name}/{x}/_SUCCESS"))

    def _folded(self) -> set[str]:
        """Batches that the newest base holds, by the list inside it."""
        base = self._base()
        if base is None:
            return set()
        with_ = self._fs.open(self._path(f"{self.folder}/base/{base}/_batches"))
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(with_, "UTF-8")
        with_.close()
        return set(text.split("\n")) - {""}

    def _base(self) -> str | None:
        return max(self._names("base"), default=None)

    def batches(self) -> list[str]:
        """Committed batches that the base does not hold."""
        folded = self._folded()
        return [b for b in self._names("batches") if b not in folded]

    def committed(self, batch: str) -> bool:
        return self._exists(f"batches/{batch}/_SUCCESS") or batch in self._folded()

    def _commit(self, staged: str, place: str) -> bool:
        """Rename a finished write onto an absent place, and nothing else: what is there stays. False, with the write thrown away, if another driver was first."""
        self._fs.mkdirs(self._path(place).getParent())
        sc = self.spark.sparkContext
        none = sc._gateway.new_array(getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        context = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), sc._jsc.hadoopConfiguration())
        try:
            context.rename(self._path(staged), self._path(place), none)  # without the option to overwrite
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            self._fs.delete(self._path(staged), True)
            return False
        return True

    def apply(self, batch: str, amounts: DataFrame) -> bool:
        """Commit a batch of signed amounts; False if that id was committed before, or by another driver meanwhile.

        Written beside its place and then renamed onto it if it is absent, so a half-written batch never counts and no commit is ever taken back."""
        if not batch or "/" in batch or batch.startswith(("_", ".")):
            raise ValueError(f"bad batch id: {batch!r}")
        if self.committed(batch):
            return False
        staged = f"{self.folder}/staged/{batch}-{uuid.uuid4().hex}"  # two drivers never write to one place
        reduced(amounts).write.parquet(staged)
        return self._commit(staged, f"{self.folder}/batches/{batch}")

    def totals(self) -> DataFrame:
        """One row per key with docs, tokens and bytes of what the committed batches leave."""
        paths = [f"{self.folder}/batches/{b}" for b in self.batches()]
        if base := self._base():
            paths.append(f"{self.folder}/base/{base}")
        rows = self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)
        return reduced(rows)

    def compact(self) -> None:
        """Fold the committed batches into a new base that lists them.

        The rename of the base is the commit: before it the batches count, after it the list inside does,
        so a driver lost at any point changes no total; leftovers are removed by the next call. Of two drivers that
        compact at once one base stays; both hold what they list, so either is right."""
        before, held = self._base(), self.batches()
        if held:
            staged = f"{self.folder}/staged/base-{uuid.uuid4().hex}"
            self.totals().write.parquet(staged)
            out = self._fs.create(self._path(f"{staged}/_batches"), True)
            out.write("\n".join(sorted({*held, *self._folded()})).encode())
            out.close()
            self._commit(staged, f"{self.folder}/base/{int(before or '0') + 1:08d}")
        folded, base = self._folded(), self._base()
        for b in self._names("batches"):
            if b in folded:
                self._fs.delete(self._path(f"{self.folder}/batches/{b}"), True)
        for old in self._names("base"):
            if old != base:
                self._fs.delete(self._path(f"{self.folder}/base/{old}"), True)


def op4(spark, sf_dir) -> DataFrame:
    """A life of the table: all documents inserted under two versions; ids divisible by 7 revised, their last word cut and their
    language taken away; the source that has most documents moved from one version of the word tokenizer to the next; ids divisible by 11
    deleted; two of the batches delivered twice. (The pieces of a real tokenizer are a version like the others; its counts have no SQL,
    so this query has none of them and the tests do.)"""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    roll = Rollup(spark, f"{shared_dir(spark)}/rollup-{spark.sparkContext._jvm.java.util.UUID.randomUUID()}")
    every = ["words-1", "chars4-1"]
    roll.apply("0001-insert", signed(counts(docs, every), 1))
    sevenths = F.col("doc_id") % 7 == 0
    edited = without_last_word(F.coalesce("text", F.lit("")))
    old = docs.where(sevenths)
    new = old.withColumn("text", edited).withColumn("lang", F.lit("unk"))
    change = revised(counts(old, every), counts(new, every))
    roll.apply("0002-revise", change)
    largest = roll.totals().groupBy("source").agg(F.sum("docs").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("source")).limit(1)
    # what is there now, as the revision has left it
    now = docs.withColumns({"text": F.when(sevenths, edited).otherwise(F.col("text")), "lang": F.when(sevenths, "unk").otherwise(F.col("lang"))})
    moved = F.broadcast(largest.select("source"))
    of_largest = now.alias("d").join(moved.alias("m"), F.col("d.source").eqNullSafe(F.col("m.source")), "left_semi")
    roll.apply("0003-retokenize", revised(counts(of_largest, ["words-1"]), counts(of_largest, ["words-2"])))
    gone = now.where("doc_id % 11 = 0")
    staying = gone.alias("d").join(moved.alias("m"), F.col("d.source").eqNullSafe(F.col("m.source")), "left_anti")
    leaving = gone.alias("d").join(moved.alias("m"), F.col("d.source").eqNullSafe(F.col("m.source")), "left_semi")
    deletes = signed(counts(staying, every).unionByName(counts(leaving, ["words-2", "chars4-1"])), -1)
    roll.apply("0002-revise", change)
    roll.apply("0004-delete", deletes)
    roll.compact()
    roll.apply("0004-delete", deletes)
    return roll.totals()


_KEPT = "doc_id % 11 <> 0 OR doc_id IS NULL"
OP4_SQL = f"""
WITH big AS (SELECT source FROM documents GROUP BY source ORDER BY count(*) DESC, source NULLS LAST LIMIT 1),
d AS (
  SELECT doc_id, documents.source, documents.source IS NOT DISTINCT FROM big.source AS moved, CASE WHEN doc_id % 7 = 0 THEN 'unk' ELSE lang END AS lang,
    CASE WHEN doc_id % 7 = 0 THEN regexp_replace(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]*$', '') ELSE coalesce(text, '') END AS t
  FROM documents, big WHERE {_KEPT}),
c AS (
  SELECT source, lang, CASE WHEN moved THEN 'words-2' ELSE 'words-1' END AS tokenizer, len(list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''))
    + CASE WHEN moved THEN length(t) - length(translate(t, '.,;:!?', '')) ELSE 0 END AS tokens, octet_length(encode(t)) AS bytes FROM d
  UNION ALL SELECT source, lang, 'chars4-1', ceil(length(t) / 4.0)::BIGINT, octet_length(encode(t)) FROM d)
SELECT source, lang, tokenizer, count(*)::BIGINT AS docs, sum(tokens)::BIGINT AS tokens, sum(bytes)::BIGINT AS bytes FROM c GROUP BY ALL
"""
