"""What the corpus operators share: durable intermediate tables, row keys and worker-side caches."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossator.sources.storage import durable, fresh_path, open_fs, publish, qualified, shared_dir

__all__ = ["SPACE", "WORD", "along_salts", "documents", "durable", "fresh_path", "give_back", "id_crc", "lots", "open_fs", "publish", "qualified", "shared_dir", "small", "spare_name", "spent_shuffles_removed", "worker_cache"]

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def spare_name(df: DataFrame, name: str) -> str:
    """name, lengthened until df has no such column (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def id_crc(doc_id: Column) -> Column:
    """CRC-32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def along_salts(rows: DataFrame, key: list[str], salted_by: list[str], first: Column) -> DataFrame:
    """The rows whose key occurs more than once, each with ``first``, the least value of that struct among all rows of
    its key. ``first`` must tell all rows apart; a row that is repeated counts as one that occurs more than once.

    A key's rows are counted by (key, salt) first, the salt being a hash of the columns ``salted_by``, and each salt that
    occurs is handed the key's value. So a key with a third of all rows is as many keys as there are salts, in the
    aggregation and in the join, and nothing is multiplied.
    """
    salt = spare_name(rows, "_salt")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn(salt, F.pmod(F.xxhash64(*salted_by), F.lit(n)))
    by_salt = rows.groupBy(*key, salt).agg(F.min(first).alias("first"), F.count("*").alias("_n"))
    tops = by_salt.groupBy(*key).agg(F.min("first").alias("first"), F.sum("_n").alias("_n")).where("_n > 1").drop("_n")
    return rows.join(by_salt.select(*key, salt).join(tops, key), [*key, salt]).drop(salt)


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def spent_shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Tables that are built within lose their shuffle files as soon as the job that they are computed by has ended.

    Otherwise those files stay until the driver happens to collect its garbage, so a method of many rounds holds the
    files of all of them. What is built within should be made durable within: a table that is run again from the same
    reference is computed again. Spark before 4.1 does not know the setting and keeps the files."""
    held = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREE_SHUFFLES) if held is None else spark.conf.set(FREE_SHUFFLES, held)


def worker_cache(owner: str) -> dict:
    """A dict that lives as long as the Python worker does, across its tasks, until another owner asks for one."""
    home = sys.modules.setdefault("_glossator_worker", types.ModuleType("_glossator_worker"))
    if getattr(home, "owner", None) != owner:
        home.owner, home.cache = owner, {}
        give_back()
    return home.cache


def give_back() -> None:
    """Hands the memory that is free in this Python worker back to the system. A worker lives on from task to task, and
    what its allocators keep counts for the executor as if it were in use."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


#: Bytes of a slice, about, and rows at most.
SLICE_BYTES, SLICE_ROWS = 4 << 20, 1024


def weights(b: pa.RecordBatch) -> np.ndarray:
    """About how many bytes each row of the batch has in its texts and lists."""
    out = np.full(b.num_rows, 16, np.int64)
    for c in b.columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type):
            out += pc.binary_length(c).fill_null(0).to_numpy(zero_copy_only=False)
        elif pa.types.is_list(c.type) or pa.types.is_large_list(c.type):
            out += 32 * pc.list_value_length(c).fill_null(0).to_numpy(zero_copy_only=False)
    return out


def small(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``size`` bytes, one row at least, so that few texts are Python objects at a
    time; an empty batch stays one. Behind the last one free memory is given back."""
    for b in batches:
        if not b.num_rows:
            yield b
            continue
        ends, i = np.cumsum(weights(b)), 0
        while i < b.num_rows:
            j = int(np.searchsorted(ends, (ends[i - 1] if i else 0) + size, "right"))
            j = min(max(j, i + 1), i + rows)
            yield b.slice(i, j - i)
            i = j
    give_back()


def lots(text: str | bytes, size: int = 1 << 20) -> Iterator[str | bytes]:
    """The text in pieces of about ``size``, cut before a space, so that of a very long text little is in hand at once."""
    space, i = (b" " if isinstance(text, bytes) else " "), 0
    while len(text) - i > size:
        k = text.find(space, i + size)
        if k < 0:
            break
        yield text[i:k]
        i = k
    yield text[i:] if i else text
