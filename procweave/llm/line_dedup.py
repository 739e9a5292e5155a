"""Lines that many documents share, found with levelled sorted runs of line hashes.

A line's key is the line without the white space at its ends and with A-Z lower-cased; its hash
is the MD5 of the key, 16 bytes. LineRuns keeps, in a shared folder, runs of (hash, documents of its
batches that have it, documents in all up to then), each bucketed by hash and sorted inside its
buckets. A new batch of documents is counted by hash into the same buckets and merge-joined with the
runs, which are read and not shuffled: hashes that the runs have settled already (those in min_docs
documents, for which more counts change nothing) are left out, the others get what was counted
before, and become a run of their own at level 0. When a level holds `fanout` runs, they are merged
bucket by bucket into one run of the next level, so a hash is in as many runs as there are levels,
about log(batches). The batch that brings a hash to min_docs is the last to write it, so the
frequent hashes are a filter over the runs.

A manifest in the folder lists the runs after each batch, so a later job goes on where one ended; a
run that its manifest doesn't list, as its job was lost, doesn't count.

Null or empty texts are one empty line, whose key is too short to be dropped. Each row counts as a
document, repeated rows too. An empty table gives no runs and no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procweave.llm.text import slices
from procweave.session import CLEANUP, Staging, settings

#: White space that is stripped from lines; a fixed value of the key.
STRIP = b" \t\n\x0b\x0c\r"


def line_hash(line: bytes, min_chars: int = 1) -> bytes | None:
    """The hash of a line's key; None if the key has under min_chars code points."""
    key = line.strip(STRIP).lower()  # bytes.lower() changes A-Z alone
    if len(key) < min_chars or min_chars > 1 and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return hashlib.md5(key, usedforsecurity=False).digest()


def hashed_lines(docs: DataFrame, text: str, min_chars: int = 1) -> DataFrame:
    """(text_hash, line_hash): each row's distinct line hashes."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            texts, keys = [], []
            for t in batch.column(0).cast(pa.binary()).to_pylist():
                if t:
                    found = {line_hash(x, min_chars) for x in t.split(b"\n")} - {None}
                    texts += [hashlib.md5(t, usedforsecurity=False).digest()] * len(found)
                    keys += found
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array(keys, pa.binary())], ["text_hash", "line_hash"])

    return docs.select(text).mapInArrow(lines, "text_hash binary, line_hash binary")


#: Rows of hashes for each bucket, and the most buckets: beyond, buckets grow, as merges need no memory.
BUCKET_ROWS, MOST_BUCKETS = 1_000_000, 20_000


class LineRuns:
    """The runs in a folder: those that its manifest lists, or none yet, in buckets of a number that stays."""

    def __init__(self, spark: SparkSession, folder: str, min_docs: int = 10, fanout: int = 2, buckets: int = 16):
        self.spark, self.folder, self.min_docs, self.fanout, self.buckets = spark, folder.rstrip("/"), min_docs, fanout, buckets
        self.version, self.levels = 0, [[]]
        try:
            every = spark.read.parquet(f"{self.folder}/manifest")
            listed = every.join(every.agg(F.max("version").alias("version")), "version").orderBy("level", "place").collect()
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            listed = []
        for r in listed:
            if (r["min_docs"], r["fanout"]) != (min_docs, fanout):
                raise ValueError(f"these runs were counted with min_docs={r['min_docs']} and fanout={r['fanout']}")
            self.version, self.buckets = r["version"], r["buckets"]
            while len(self.levels) <= r["level"]:
                self.levels.append([])
            self.levels[r["level"]].append(r["run"])
        for name in self.names():
            spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (line_hash BINARY, n_docs BIGINT, total BIGINT) USING parquet CLUSTERED BY (line_hash) SORTED BY (line_hash) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{name}'")

    def names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def _settings(self):
        """As many partitions as buckets, and runs known to be sorted: neither they nor a batch move twice."""
        return settings(self.spark, {
            "spark.sql.shuffle.partitions": str(self.buckets), "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false", CLEANUP: "true",
        })

    def _write(self, rows: DataFrame) -> str:
        name = f"pw_lines_{uuid.uuid4().hex}"
        with self._settings():
            rows.write.bucketBy(self.buckets, "line_hash").sortBy("line_hash").format("parquet").option("compression", "zstd").option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def _list(self) -> None:
        """Writes the manifest's next version, whole or not at all."""
        self.version += 1
        rows = [(self.version, level, place, name, self.buckets, self.min_docs, self.fanout) for level, own in enumerate(self.levels) for place, name in enumerate(own)]
        listed = self.spark.createDataFrame(rows, "version int, level int, place int, run string, buckets int, min_docs long, fanout int")
        listed.coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")

    def frequent(self) -> DataFrame:
        """Hashes found in min_docs documents or more, each once."""
        found = self.spark.createDataFrame([], "line_hash binary")
        for name in self.names():
            found = found.unionByName(self.spark.table(name).where(F.col("total") >= self.min_docs).select("line_hash"))
        return found

    def counted(self, hashes: DataFrame) -> DataFrame:
        """(line_hash, n_docs, total) of a batch, without the hashes that the runs have settled."""
        counts = hashes.groupBy("line_hash").agg(F.count("*").alias("n_docs")).withColumn("before", F.lit(0).cast("long"))
        for name in self.names():
            run = self.spark.table(name).select("line_hash", F.col("n_docs").alias("more")).hint("merge")
            counts = counts.join(run, "line_hash", "left").select("line_hash", "n_docs", (F.col("before") + F.coalesce("more", F.lit(0))).alias("before"))
        return counts.where(F.col("before") < self.min_docs).select("line_hash", "n_docs", (F.col("before") + F.col("n_docs")).alias("total"))

    def merged(self, names: list[str]) -> DataFrame:
        """Runs as one. Two are merged bucket by bucket; Spark moves the outcome again to merge it with a third."""
        every = self.spark.table(names[0])
        for name in names[1:]:
            more = self.spark.table(name).select("line_hash", F.col("n_docs").alias("more"), F.col("total").alias("later")).hint("merge")
            zero = F.lit(0).cast("long")
            every = every.join(more, "line_hash", "full").select("line_hash", (F.coalesce("n_docs", zero) + F.coalesce("more", zero)).alias("n_docs"), F.greatest("total", "later").alias("total"))
        return every

    def add(self, hashes: DataFrame) -> None:
        """A batch of (line_hash), a row for each document that has it."""
        self.levels[0].append(self._write(self.counted(hashes)))
        self._list()
        self.compact()

    def compact(self) -> None:
        """Merges the runs of every level that is full into one of the next."""
        for level in range(len(self.levels) + 1):
            if level < len(self.levels) and len(self.levels[level]) >= self.fanout:
                old, self.levels[level] = self.levels[level], []
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append(self._write(self.merged(old)))
                self._list()
                self._forget(old)

    def _forget(self, names: list[str]) -> None:
        staging = Staging(self.spark, "lines", self.folder)
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            staging.drop(name)

    def close(self, keep: bool = True) -> None:
        """Takes the runs out of the catalog; the folder keeps them for a later job, unless told not to."""
        for name in self.names():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        if not keep:
            Staging(self.spark, "lines", self.folder).drop()


def _drop_lines(min_chars: int, row: str):
    schema = {"n_lines": pa.int64(), "n_dropped": pa.int64()}

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__pw_text"):
            texts, total, dropped = [], [], []
            hits = batch.column("__pw_hits").to_pylist()
            for t, hit in zip(batch.column("__pw_text").cast(pa.binary()).to_pylist(), hits, strict=True):
                lines = (t or b"").split(b"\n")
                keep = lines
                if hit:
                    hit = set(hit)
                    keep = [x for x in lines if line_hash(x, min_chars) not in hit]
                texts.append(t if t is None or len(keep) == len(lines) else b"\n".join(keep))
                total.append(len(lines))
                dropped.append(len(lines) - len(keep))
            out = [batch.column(row), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*out, *(pa.array(v, k) for v, k in zip((total, dropped), schema.values(), strict=True))], [row, "kept_text", *schema])

    return drop


def drop_shared_lines(docs: DataFrame, text: str = "text", min_docs: int = 10, min_chars: int = 1, batches: int = 4, fanout: int = 2, folder: str | None = None) -> DataFrame:
    """(row, kept_text, n_lines, n_dropped) for each row of docs; row is a struct of its other columns.

    Lines whose key has at least min_chars code points and is in min_docs rows or more are dropped
    everywhere. docs is taken in `batches` batches of its partitions, as if they came one after another.
    folder: where the runs of earlier jobs are and those of this one stay, whose documents count too; the
    lines of these rows alone if there is none."""
    spark = docs.sparkSession
    staging = Staging(spark, "lines")
    hashed = hashed_lines(docs, text, min_chars).withColumn("batch", F.spark_partition_id() % batches)
    hashed = staging.write(hashed, "hashed", ["batch"])
    buckets = min(MOST_BUCKETS, max(1, -(-hashed.count() // BUCKET_ROWS)))
    runs = LineRuns(spark, folder or f"{staging.root}/runs", min_docs, fanout, buckets)
    for k in range(batches):
        runs.add(hashed.where(F.col("batch") == k).select("line_hash"))
    frequent = staging.write(runs.frequent(), "frequent")
    runs.close(keep=folder is not None)
    hits = hashed.join(frequent, "line_hash", "left_semi").groupBy("text_hash").agg(F.collect_set("line_hash").alias("__pw_hits"))
    hits = staging.write(hits, "hits")
    staging.keep("hits")
    rest = [docs[c] for c in docs.columns if c != text] or [F.lit(0).alias("none")]
    packed = docs.select(F.struct(*rest).alias("row"), F.col(text).alias("__pw_text"))
    joined = packed.withColumn("text_hash", F.unhex(F.md5(F.coalesce("__pw_text", F.lit(""))))).join(hits, "text_hash", "left").select("row", "__pw_text", "__pw_hits")
    row_type = packed.schema["row"].dataType.simpleString()
    out = joined.mapInArrow(_drop_lines(min_chars, "row"), f"row {row_type}, kept_text string, n_lines long, n_dropped long")
    return out


def without_shared_lines(docs: DataFrame, text: str = "text", **settings: int) -> DataFrame:
    """docs with the shared lines taken out of the text; all rows and columns stay."""
    out = drop_shared_lines(docs, text, **settings)
    return out.select(*[F.col("kept_text").alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns])


SQL = r"""
WITH l AS (
  SELECT doc_id, p, x,
         translate(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(s) AS x, unnest(range(len(s))) AS p
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))
), f AS (
  SELECT k FROM l WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (f.k IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(x, chr(10) ORDER BY p) FILTER (f.k IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN f ON l.k = f.k GROUP BY doc_id
"""
