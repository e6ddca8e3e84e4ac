"""Lines that recur across documents, counted in levelled sorted runs.

The store is a list of runs; a run is a Parquet folder of (key, number of documents), sorted by key. A batch of documents adds
one run of level 0. When a level holds FAN_IN runs they are merged into one run of the next level, so n batches leave
O(log n) runs and each count is rewritten O(log n) times. Looking lines up merges the runs by key.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, durable
from .columns import SPACES, ascii_lower, field, fresh, hash_pair, whole

FAN_IN = 4
MIN_DOCUMENTS = 10
MIN_CHARS = 1
BATCHES = 4
RESULTS = ("kept_text", "n_lines", "n_dropped")


def lines_of(text: Column) -> Column:
    return F.split(whole(text), "\n", -1)


def keys_of(text: Column) -> Column:
    """Per line two 64-bit hashes of it without outer white space, A-Z lower-cased; null for keys below the least length.

    One ``transform`` for each step: inside a lambda nothing that is used twice would be computed once.
    """
    bare = F.transform(F.transform(lines_of(text), lambda x: F.btrim(x, F.lit(SPACES))), ascii_lower)
    return F.transform(bare, lambda x: F.when(F.length(x) >= MIN_CHARS, hash_pair(x)))


class LineRuns:
    """Levelled runs of line keys in the shared folder; each run is sorted by key and holds a key once."""

    def __init__(self, spark: SparkSession, fan_in: int = FAN_IN):
        self.spark, self.fan_in = spark, fan_in
        self.root = f"{checkpoint_dir(spark)}/runs-{uuid.uuid4().hex}"
        self.levels: list[list[str]] = []

    def _write(self, counts: DataFrame, level: int) -> None:
        path = f"{self.root}/{level}-{uuid.uuid4().hex}"
        counts.sortWithinPartitions("a", "b").write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def _merged(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema("a long, b long, n long").parquet(*paths).groupBy("a", "b").agg(F.sum("n").alias("n"))

    def add(self, keyed: DataFrame) -> None:
        """Counts the documents of a batch (one array ``keys`` each) that hold each key, as a new run; merges full levels."""
        held = F.array_distinct(F.filter("keys", lambda k: k.isNotNull()))
        self._write(keyed.select(F.explode(held).alias("k")).groupBy("k.a", "k.b").agg(F.count("*").alias("n")), 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fan_in:
            full, self.levels[level] = self.levels[level], []
            self._write(self._merged(full), level + 1)
            level += 1

    def counts(self) -> DataFrame:
        """(a, b, n) over all runs."""
        paths = [p for level in self.levels for p in level]
        return self._merged(paths) if paths else self.spark.createDataFrame([], "a long, b long, n long")


def _row(docs: DataFrame) -> Column:
    """A row by its content: equal rows are one row here, and lose the same lines."""
    return hash_pair(*map(field, docs.columns))


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    """(row, keys) per document, written once: the texts are cut into lines and hashed in one pass."""
    return durable(docs.select(_row(docs).alias("row"), keys_of(field(text_col)).alias("keys")))


def _minus(docs: DataFrame, text_col: str, keyed: DataFrame, common: DataFrame) -> DataFrame:
    """``docs`` without the lines whose key is in ``common``: adds the text that stays, the lines and the dropped lines."""
    row, part, at = fresh(docs, "row", "part", "at")
    each = keyed.select("row", F.posexplode("keys").alias("i", "k")).where("k is not null").select("row", "i", "k.a", "k.b")
    hits = each.join(common, ["a", "b"], "left_semi").groupBy("row").agg(F.collect_set("i").alias(at))
    both = docs.withColumn(row, _row(docs)).join(hits.withColumnRenamed("row", row), row, "left").withColumn(
        part, lines_of(field(text_col)))
    gone = F.coalesce(field(at), F.array().cast("array<int>"))
    stay = F.when(F.size(gone) == 0, field(part)).otherwise(F.filter(field(part), lambda x, i: ~F.array_contains(gone, i)))
    return both.select(
        *map(field, docs.columns), F.array_join(stay, "\n").alias("kept_text"), F.size(field(part)).cast("long").alias("n_lines"),
        F.size(gone).cast("long").alias("n_dropped"))


def _batches(docs: DataFrame, batches: int) -> list[DataFrame]:
    """The deliveries of a table on disk: its files in order, in ``batches`` groups, each read once. Else the table itself."""
    files = sorted(docs.inputFiles())
    if len(files) < 2:
        return [docs]
    step = -(-len(files) // batches)
    read = docs.sparkSession.read.schema(docs.schema)
    return [read.parquet(*files[i:i + step]) for i in range(0, len(files), step)]


def drop_common_lines(docs: DataFrame, text_col: str = "text", min_documents: int = MIN_DOCUMENTS,
                      batches: list[DataFrame] | None = None, fan_in: int = FAN_IN) -> DataFrame:
    """``docs`` with kept_text, n_lines and n_dropped: lines whose key is in ``min_documents`` documents or more are gone.

    ``batches`` are the parts of ``docs`` in the order they arrived (``docs`` as one batch if left out). A null or empty text is
    one empty line. Keys without a character are never counted. Each row counts as a document, repeated rows too. Columns of
    ``docs`` named like a result are replaced, all others pass through. An empty table gives no rows.
    """
    docs = docs.drop(*RESULTS)
    runs, keyed = LineRuns(docs.sparkSession, fan_in), None
    for batch in batches or [docs]:
        one = _keyed(batch.select(*map(field, docs.columns)), text_col)
        runs.add(one)
        keyed = one if keyed is None else keyed.unionByName(one)
    common = durable(runs.counts().where(F.col("n") >= min_documents).select("a", "b"))
    return _minus(docs, text_col, keyed, common)


def drop_seen_lines(batch: DataFrame, runs: LineRuns, text_col: str = "text") -> DataFrame:
    """The arriving form: ``batch`` without the lines that the runs already hold; then the batch is added to the runs.

    The runs are read as they were before the call. Null texts, repeated rows and extra columns are treated as above.
    """
    batch = batch.drop(*RESULTS)
    keyed, seen = _keyed(batch, text_col), durable(runs.counts().select("a", "b"))
    runs.add(keyed)
    return _minus(batch, text_col, keyed, seen)


def op3_line_runs(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    full = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return drop_common_lines(docs, batches=_batches(full, BATCHES)).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP3_SQL = r"""
with l as (
  select doc_id, i, parts[i] as line,
         translate(trim(parts[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents) d,
       unnest(range(1, len(parts) + 1)) as u(i)),
c as (select key from l where key <> '' group by key having count(distinct doc_id) >= 10)
select doc_id, count(*) as n_lines, count(*) filter (where c.key is not null) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (where c.key is null), '')) as kept_sha256
from l left join c on l.key = c.key group by doc_id
"""
