"""Product quantisation in exact integers, with float32 matrix products that only screen.

A vector's components become integers, and it is cut into parts; each part position has a codebook, and a
part's code is the nearest entry of it. Distances are ``|x|^2 - 2 x.c + |c|^2``, of which the first term is the
same for all entries, so what tells entries apart is one product of the matrix of parts with the codebook. It is
taken in float32. A sum of w products of float32 numbers, in whatever order it is added up, is off by at most
``g / (1 - g)`` times the sum of the products' magnitudes, g being w + 2 roundings of 2^-24 (two for making
float32 of the integers), and that sum is at most ``|x| |c|``. So each entry has an interval that holds its exact
distance. Entries whose interval lies above the least upper end cannot win; all others are computed again in
int64, and the least index among the equally near ones is the code. No rounding can reach the result.

The codebooks are bounded (parts x entries), so each round sends them to all tasks; a task returns one sum and
count for each entry that it met, which are added up before anything comes to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossator.llm.common import durable, small
from glossator.llm.vectors import integers, largest, sound, widest

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rounding of float32, relative.
UNIT = 2.0**-24
#: Rows that are screened together.
BLOCK = 2048
#: Dimensions of an entry's sum in one row of a task's result.
SLICE = 16
#: Labels whose sums may be broadcast.
BROADCAST_LABELS = 100_000


def screened(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of x, entry of book), in ascending order, that hold every nearest entry: those whose interval
    overlaps the best one's."""
    w = max(1, x.shape[1])
    g = (w + 2) * UNIT
    g = g / (1 - g) * (1 + 1e-9)
    square = (book * book).sum(1)
    length = np.sqrt(square.astype(np.float64))
    columns = np.ascontiguousarray(book.astype(np.float32).T)
    rows, entries = [], []
    for i in range(0, len(x), BLOCK):
        part = x[i : i + BLOCK].astype(np.float32)
        product = (part @ columns).astype(np.float64)
        own = np.sqrt((x[i : i + BLOCK].astype(np.float64) ** 2).sum(1))
        middle = square - 2 * product
        # The second term covers what float64 rounds in the lines above.
        reach = 2 * g * own[:, None] * length + 2.0**-48 * (square + 2 * np.abs(product) + 2 * own[:, None] * length)
        r, c = np.nonzero(middle - reach <= (middle + reach).min(1)[:, None])
        rows.append(r + i)
        entries.append(c)
    return np.concatenate(rows), np.concatenate(entries)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of x the index of the nearest entry of the book, the lowest of equally near ones, and the squared
    distance; both in exact integers."""
    if not len(x):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    rows, entries = screened(x, book)
    far = np.empty(len(rows), np.int64)
    for i in range(0, len(rows), 1 << 16):
        far[i : i + (1 << 16)] = ((x[rows[i : i + (1 << 16)]] - book[entries[i : i + (1 << 16)]]) ** 2).sum(1)
    first = np.flatnonzero(np.diff(rows, prepend=-1))
    least = np.minimum.reduceat(far, first)
    won = np.flatnonzero(far == np.repeat(least, np.diff(first, append=len(rows))))
    won = won[np.flatnonzero(np.diff(rows[won], prepend=-1))]  # entries ascend within a row
    return entries[won], least


def first_books(rows: DataFrame, dims: int, parts: int, entries: int, scale: int) -> np.ndarray:
    """The parts of the ``entries`` first vectors by id: (parts, entries, width). Nothing else comes to the driver."""
    found = rows.where(sound(F.col("v"))).orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").toArrow()
    x = integers(found.column(0).combine_chunks(), scale, dims, largest(dims, 2))[1]
    return x.reshape(len(x), parts, dims // parts).transpose(1, 0, 2)


def moved(rows: DataFrame, books: np.ndarray, scale: int) -> np.ndarray:
    """The books after one round: each entry the floor of the mean of its parts, unused ones as they were."""
    parts, entries, width = books.shape
    sent = rows.sparkSession.sparkContext.broadcast(books)
    slices = -(-width // SLICE)
    fields = [f"s{i}" for i in range(SLICE)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        sums, counts = np.zeros(own.shape, np.int64), np.zeros(own.shape[:2], np.int64)
        for b in small(batches):
            x = integers(b.column(0), scale, parts * width, largest(parts * width, 2))[1]
            for p in range(parts):
                part = x[:, p * width : (p + 1) * width]
                code = nearest(part, own[p])[0]
                np.add.at(sums[p], code, part)
                counts[p] += np.bincount(code, minlength=entries)
        p, e = np.nonzero(counts)
        padded = np.zeros((len(p), slices * SLICE), np.int64)
        padded[:, :width] = sums[p, e]
        for i in range(slices):
            columns = [p, e, np.full(len(p), i), counts[p, e], *padded[:, i * SLICE : (i + 1) * SLICE].T]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["part", "entry", "slice", "n", *fields])

    schema = ", ".join(f"{c} long" for c in ("part", "entry", "slice", "n", *fields))
    told = rows.select("v").mapInArrow(run, schema).groupBy("part", "entry", "slice").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in fields)).toArrow()
    out = books.copy()
    p, e, i, n = (told.column(c).to_numpy() for c in ("part", "entry", "slice", "n"))
    means = np.stack([told.column(c).to_numpy() for c in fields], axis=1) // n[:, None]  # floors go down
    for k in range(slices):
        mine = i == k
        out[p[mine], e[mine], k * SLICE : (k + 1) * SLICE] = means[mine, : min(SLICE, width - k * SLICE)]
    sent.unpersist()
    return out


def learn_books(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> np.ndarray:
    """Codebooks (parts, entries, width) of rows (vec_id, v array<double>) after ``rounds`` rounds."""
    dims = -(-max(parts, widest(rows.where(sound(F.col("v"))))) // parts) * parts
    books = first_books(rows, dims, parts, entries, scale)
    for _ in range(rounds if books.shape[1] else 0):
        books = moved(rows, books, scale)
    return books


def encoded(rows: DataFrame, books: Broadcast, scale: int = SCALE) -> DataFrame:
    """vec_id, label, code (two hexadecimal digits a part, more where a book has over 256 entries) and error (the
    squared distances of all parts) of every sound row of rows (vec_id, label, v array<double>)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = books.value
        parts, entries, width = own.shape
        digits = max(2, (max(1, entries - 1).bit_length() + 3) // 4)
        names = np.array([f"{i:0{digits}x}" for i in range(max(1, entries))])
        for b in small(batches):
            kept, x = integers(b.column(2), scale, parts * width, largest(parts * width, 2))
            found = [nearest(x[:, p * width : (p + 1) * width], own[p]) for p in range(parts)]
            code = np.array(["".join(c) for c in zip(*(names[i].tolist() for i, _ in found), strict=True)], dtype=object)
            error = np.sum([d for _, d in found], axis=0, dtype=np.int64)
            at = pa.array(kept)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(code, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return rows.select("vec_id", "label", "v").mapInArrow(run, "vec_id long, label string, code string, error long")


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_error(codes: DataFrame) -> DataFrame:
    """codes with label_error, the error summed over the rows of the same label, those without one together.

    Few labels are sent to all tasks. Beyond that labels are joined by (label, salt): each label's sum is handed to
    those of its salts that occur, so a label with a third of all rows is as many keys as there are salts.
    """
    salts = int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = [F.col("label").isNull().alias("_none"), F.coalesce("label", F.lit("")).alias("_label")]
    rows = codes.select("*", *key, F.pmod(F.xxhash64("vec_id", "code"), F.lit(salts)).alias("_salt"))
    by_salt = rows.groupBy("_none", "_label", "_salt").agg(F.sum("error").alias("e"))
    sums = durable(by_salt.groupBy("_none", "_label").agg(F.sum("e").alias("label_error")))
    if sums.count() <= BROADCAST_LABELS:
        return rows.join(F.broadcast(sums), ["_none", "_label"]).select(*codes.columns, "label_error")
    told = by_salt.drop("e").join(sums, ["_none", "_label"])
    return rows.join(told, ["_none", "_label", "_salt"]).select(*codes.columns, "label_error")


def vector_codes(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(codes, books): vec_id, label, code and error of every row with a sound vector, and the codebooks.

    Rows whose vector is null or has null, NaN or infinite components are left out. Vectors shorter than the
    longest, rounded up to a multiple of ``parts``, have zeros behind them, the empty one throughout. Scaled
    components are held to a magnitude for which distances fit a long (2^27 at 64 dimensions, or 131072 before
    scaling). Books begin with the vectors of the smallest ids; fewer vectors give smaller books; a null id comes
    last; of one id the lesser vector comes first. Repeated rows each count and each give a row; an empty table
    gives none; other columns are ignored.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(embedding).cast("array<double>").alias("v"))
    books = learn_books(rows, parts, entries, rounds, scale)
    sent = vectors.sparkSession.sparkContext.broadcast(books)
    return encoded(rows, sent, scale), books


def vector_code_report(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every row with a sound vector."""
    codes, books = vector_codes(vectors, **options)
    return with_label_error(durable(codes)).select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def decoded(codes: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """codes with ``vector``, the vector that each code stands for: each part's entry, in the units of the input."""
    width = books.shape[2]
    digits = max(2, (max(1, books.shape[1] - 1).bit_length() + 3) // 4)
    sent = codes.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for b in batches:
            names = b.column(b.schema.get_field_index("code")).to_pylist()
            at = np.array([[int(c[p * digits : (p + 1) * digits], 16) for p in range(len(own))] for c in names], np.int64).reshape(len(names), len(own))
            flat = np.concatenate([own[p][at[:, p]] for p in range(len(own))], axis=1).astype(np.float64) / scale
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(names) + 1) * width * len(own), pa.int32()), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], names=[*b.schema.names, "vector"])

    schema = ", ".join(f"`{c}` {t}" for c, t in codes.dtypes)
    return codes.mapInArrow(run, f"{schema}, vector array<double>")

