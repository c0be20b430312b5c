"""Papers kept by document: results are put into them, and what they do not touch stays as it is."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossator.plans import report
from glossator.sources.storage import durable, qualified

BUCKETS = 64
KEPT_VERSIONS = 2
PAPER = f"doc_id bigint, slug string, title string, paragraphs array<struct<index:int,text:string>>, methods map<string,{report.BLOCK}>, digest string"


class PaperStore:
    """Papers at a path, in buckets by doc_id.

    A version is a small file that names the folder of every bucket. It gets its name when all its folders are complete,
    by a move onto a name that is not there, so a reader sees one version or the next, a run that is killed leaves the
    version before it, and of two writers the later one fails. Only buckets with changed papers are written anew; where
    nothing changes no file is written. A path keeps the number of buckets that it began with.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, qualified(spark, path).rstrip("/")
        self.buckets = self.version()[1].get("buckets", buckets)

    def _at(self, path: str):
        there = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return there, there.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        there, fs = self._at(f"{self.path}/versions")
        names = [x.getPath().getName() for x in fs.listStatus(there)] if fs.exists(there) else []
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"(\d{12})\.json", n)))

    def version(self, number: int | None = None) -> tuple[int, dict]:
        """The number of a version, by default the newest, and what it says; 0 and nothing where there is none."""
        number = number or max(self.versions(), default=0)
        if not number:
            return 0, {}
        rows = self.spark.read.text(f"{self.path}/versions/{number:012d}.json", wholetext=True).collect()
        return number, json.loads(rows[0].value)

    def _read(self, said: dict, buckets: list[int] | None = None) -> DataFrame:
        folders = said.get("folders", {})
        paths = [f"{self.path}/data/{folders[str(b)]}" for b in (buckets if buckets is not None else range(self.buckets)) if str(b) in folders]
        return self.spark.read.schema(PAPER).parquet(*paths) if paths else self.spark.createDataFrame([], PAPER)

    def papers(self, number: int | None = None) -> DataFrame:
        """doc_id, slug, title, paragraphs and methods, as ``report.papers`` gives them."""
        return self._read(self.version(number)[1]).drop("digest")

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int")

    def upsert(self, docs: DataFrame, blocks: DataFrame) -> int:
        """Puts blocks (doc_id, key, block) into the papers of docs (doc_id, text, was_ocr) and returns the number of the
        version that holds them. A paper that is there keeps its slug, title and paragraphs; a block replaces the one with
        its key. Documents without a doc_id are left out; of rows with the same doc_id the one with the least text is taken.
        """
        number, said = self.version()
        wanted = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("text", "was_ocr")).alias("d")).select("doc_id", "d.text", "d.was_ocr")
        touched = [r.b for r in wanted.select(self.bucket().alias("b")).distinct().collect()]
        old = self._read(said, touched)
        rows = report.papers(wanted, blocks, old)
        told = report.as_json(rows).select("doc_id", F.sha2("json", 256).alias("digest"))
        same = old.select("doc_id", F.col("digest").alias("_was"))
        changed = durable(rows.join(told, "doc_id").join(same, "doc_id", "left").where(~F.col("_was").eqNullSafe(F.col("digest"))).drop("_was"))
        dirty = [r.b for r in changed.select(self.bucket().alias("b")).distinct().collect()]
        if not dirty:
            return number
        kept = self._read(said, dirty).join(changed.select("doc_id"), "doc_id", "left_anti")
        out = changed.unionByName(kept).withColumn("bucket", self.bucket())
        lot = f"{number + 1:012d}-{self._fresh()}"
        # By ranges, so that tasks grow in number with the partitions and not with the buckets; a task is in few buckets.
        n = max(len(dirty), int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        out.repartitionByRange(n, "bucket", "doc_id").sortWithinPartitions("bucket", "doc_id").write.partitionBy("bucket").parquet(f"{self.path}/data/{lot}")
        folders = {**said.get("folders", {}), **{str(b): f"{lot}/bucket={b}" for b in dirty}}
        return self._publish(number + 1, {"buckets": self.buckets, "folders": folders})

    @staticmethod
    def _fresh() -> str:
        import uuid

        return uuid.uuid4().hex

    def _publish(self, number: int, said: dict) -> int:
        """Names a version. Another writer's version of that number makes it an error, and this one's rows are not seen."""
        jvm = self.spark.sparkContext._jvm
        part, fs = self._at(f"{self.path}/versions/_{self._fresh()}")
        out = fs.create(part)
        out.write(bytearray(json.dumps(said, sort_keys=True).encode()))
        out.close()
        hadoop = jvm.org.apache.hadoop.fs
        files = hadoop.FileContext.getFileContext(part.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        kinds = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
        kinds[0] = getattr(hadoop, "Options$Rename").NONE
        files.rename(part, hadoop.Path(f"{self.path}/versions/{number:012d}.json"), kinds)
        return number

    def vacuum(self, keep: int = KEPT_VERSIONS) -> None:
        """Removes all but the newest versions, and folders that none of those names. Not beside a writer."""
        numbers = self.versions()
        kept, gone = numbers[-keep:], numbers[:-keep]
        named = {f for n in kept for f in self.version(n)[1]["folders"].values()}
        for n in gone:
            there, fs = self._at(f"{self.path}/versions/{n:012d}.json")
            fs.delete(there, False)
        root, fs = self._at(f"{self.path}/data")
        for lot in fs.listStatus(root) if fs.exists(root) else []:
            inner = [x.getPath() for x in fs.listStatus(lot.getPath())]
            left = [p for p in inner if f"{lot.getPath().getName()}/{p.getName()}" in named]
            if not left:
                fs.delete(lot.getPath(), True)
                continue
            for p in inner:
                if p not in left and p.getName().startswith("bucket="):
                    fs.delete(p, True)
