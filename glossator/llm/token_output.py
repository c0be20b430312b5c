"""Token-ID output: one zstandard frame for each document, and a seek table at the end of each file.

File layout, little-endian throughout:

    frame 0 | frame 1 | ... | frame n-1 | skippable frame (seek table, itself one zstandard frame; trailer)

A frame holds one document's ids, each ``width`` bytes wide, and carries zstandard's own content
checksum. The seek table has six columns, each stored whole for all n documents: doc_id (int64), whether
doc_id is null (uint8), id count (uint32), compressed length (uint32), crc32 of the compressed frame
(uint32), crc32 of the ids as 32-bit integers (uint32). The trailer is ``<4sBIIII``: magic, width, n,
compressed length of the seek table, its raw length, its crc32. A reader fetches the trailer and the
table from the end of the file and then only the frames of the documents it wants. Tools that know
nothing of the table pass over the skippable frame and unpack all ids.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossator.llm.common import fresh_path, give_back, open_fs, publish, qualified, small, worker_cache

MAGIC = b"GTS1"
SKIPPABLE = 0x184D2A5E
TRAILER = "<4sBIIII"
TRAILER_SIZE = struct.calcsize(TRAILER)
#: Chunks of text that a worker remembers the ids of; the memory is emptied when it is full.
CACHE_ENTRIES = 500_000
#: Latin-1 letters in lower case, and the full stop and comma that may follow them.
LETTERS = re.compile(b"[a-z\xdf-\xf6\xf8-\xff]+").fullmatch
MARKS = (b".", b",")
PAIRS = (b"..", b".,", b",.", b",,")
#: Lowers Latin-1 and makes tab, LF and CR spaces.
LOWER = bytes(32 if i in (9, 10, 13) else ord(chr(i).lower()) if ord(chr(i).lower()) < 256 else i for i in range(256))
END_ID = 2
#: Texts are encoded together up to so many bytes.
TOGETHER = 2 << 20
DOCS_PER_FILE = 8192


# --- encoding -------------------------------------------------------------------------------------


class ChunkEncoder:
    """Whole-text ids by way of a memory of words.

    A tokenizer that lowers texts, splits them at white space and drops it gives a text the ids of its
    white-space-separated chunks in a row, and a full stop or comma after a letter or digit is a token of
    its own. So Latin-1 texts are lowered and cut at spaces, tabs and line ends and before such marks;
    Arrow finds the distinct chunks of many texts at once, and each of these is looked up. The library
    encodes new chunks, those of letters many at a time, cut up where an id ends a word. It encodes texts
    in other scripts, texts with special tokens, and texts where a mark follows another one, as they are;
    and all texts, if the tokenizer is of another kind.
    """

    def __init__(self, path: str, width: int | None = None):
        import json

        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # executors share their cores by tasks
        self.tok = Tokenizer.from_file(path)
        spec = json.loads(self.tok.to_str())
        vocab = self.tok.get_vocab(with_added_tokens=True)
        suffix = spec["model"].get("end_of_word_suffix")
        self.chunked = bool(suffix) and '"Removed"' in json.dumps(spec["pre_tokenizer"]) and '"Lowercase"' in json.dumps(spec["normalizer"])
        self.width = width or (2 if max(vocab.values(), default=0) < 1 << 16 else 4)
        self.dtype = np.dtype(f"<u{self.width}")
        self.special = [t["content"].lower().encode() for t in spec["added_tokens"]]
        self.ends = np.zeros(max(vocab.values(), default=0) + 1, bool)
        if suffix:
            self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        """Empties the memory: chunk to number, and by number its ids' place and whether it ends loosely."""
        self.numbers: dict[bytes, int] = {}
        self.used = 0
        self.flat = np.empty(1 << 16, self.dtype)
        self.start = np.zeros(1 << 16, np.int64)  # of the next number too
        self.loose = np.zeros(1 << 16, bool)  # ends in neither letter nor digit
        self._store([b"", *MARKS], np.concatenate([[0], *(self._ids(m.decode()) for m in MARKS)])[1:], np.array([0, 1, 1]))

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.dtype)

    def _store(self, chunks: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, k = len(self.numbers), len(chunks)
        while n + k + 1 > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.loose = np.concatenate([self.loose, np.zeros_like(self.loose)])
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[n : n + k] = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        self.start[n + k] = self.used
        self.numbers.update(zip(chunks, range(n, n + k), strict=True))

    def _learn(self, chunks: list[bytes]) -> None:
        words, others = [], []
        for c in chunks:
            (words if LETTERS(c) else others).append(c)
        for i in range(0, len(words), 512):
            part = words[i : i + 512]
            ids = self._ids(b" ".join(part).decode("latin-1"))
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(part) and cuts[-1] == len(ids):
                self._store(part, ids, np.diff(cuts, prepend=0))
            else:
                others += part
        if others:
            found = [np.array(e.ids, self.dtype) for e in self.tok.encode_batch([c.decode("latin-1") for c in others], add_special_tokens=False)]
            n = len(self.numbers)
            self._store(others, np.concatenate(found), np.array([len(f) for f in found]))
            self.loose[n : n + len(others)] = [not chr(c[-1]).isalnum() for c in others]

    def _prepared(self, text: str) -> bytes | None:
        if not self.chunked:
            return None
        try:
            raw = text.encode("latin-1").translate(LOWER) + b" "
        except UnicodeEncodeError:
            return None
        if any(x in raw for x in PAIRS) or any(x in raw for x in self.special):
            return None
        return raw.replace(b". ", b" . ").replace(b", ", b" , ")

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, ``width`` bytes each."""
        out: list[bytes | None] = [None] * len(texts)
        held, which, size = [], [], 0
        for k, t in enumerate(texts):
            raw = self._prepared(t)
            if raw is None:
                continue
            if len(raw) > 2 * TOGETHER:
                out[k] = self._long(raw)
                continue
            held.append(raw)
            which.append(k)
            size += len(raw)
            if size > TOGETHER:
                self._chunked(held, which, out)
                held, which, size = [], [], 0
        if held:
            self._chunked(held, which, out)
        whole = [k for k, ids in enumerate(out) if ids is None]
        if whole:
            for k, e in zip(whole, self.tok.encode_batch([texts[k] for k in whole], add_special_tokens=False), strict=True):
                out[k] = np.array(e.ids, self.dtype).tobytes()
        return out

    def _long(self, raw: bytes) -> bytes | None:
        """A long text piece by piece, cut at spaces that no mark follows."""
        pieces, i = [], 0
        while i < len(raw):
            k = raw.find(b" ", i + TOGETHER)
            while 0 <= k and raw[k + 1 : k + 3] in (b". ", b", "):
                k = raw.find(b" ", k + 1)
            z = k + 1 if k >= 0 else len(raw)
            out: list[bytes | None] = [None]
            self._chunked([raw[i:z]], [0], out)
            if out[0] is None:
                return None
            pieces.append(out[0])
            i = z
        return b"".join(pieces)

    def _chunked(self, held: list[bytes], which: list[int], out: list[bytes | None]) -> None:
        if len(self.numbers) > CACHE_ENTRIES:
            self._forget()
        data = b"".join(held)
        cut = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
        # Each chunk with its space, so that the offsets lie end to end.
        offsets = np.concatenate([[0], cut + 1]).astype(np.int32)
        chunks = pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        distinct = [c[:-1] for c in chunks.dictionary.to_pylist()]
        self._learn([c for c in distinct if c not in self.numbers])
        number = np.fromiter(map(self.numbers.__getitem__, distinct), np.int64, len(distinct))
        number = number[chunks.indices.to_numpy()]
        first = self.start[number]
        sizes = self.start[number + 1] - first
        end = np.cumsum(sizes)
        ids = self.flat[np.arange(end[-1]) + np.repeat(first - (end - sizes), sizes)]
        stop = np.searchsorted(cut, np.cumsum([len(h) for h in held]) - 1) + 1  # chunks up to each text's end
        # A mark after a loose end may belong to what stands before it.
        doubt = np.flatnonzero(self.loose[number[:-1]] & ((number[1:] == 1) | (number[1:] == 2)))
        bad = set(np.searchsorted(stop, doubt, "right").tolist())
        at = 0
        for i, (k, z) in enumerate(zip(which, end[stop - 1].tolist(), strict=True)):
            if i not in bad:
                out[k] = ids[at:z].tobytes()
            at = z


def encoder(path: str) -> ChunkEncoder:
    cache = worker_cache("tokens")
    if ("encoder", path) not in cache:
        cache["encoder", path] = ChunkEncoder(path)
    return cache["encoder", path]


# --- file format ----------------------------------------------------------------------------------


class FileWriter:
    """Writes one file of the format above. It appears under its name only when it is complete."""

    def __init__(self, path: str, width: int, attempt: str = "0"):
        import zstandard

        self.fs, self.path = open_fs(path)
        self.part = f"{self.path}.{attempt}.part"
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.out = self.fs.open_output_stream(self.part)
        self.zip = zstandard.ZstdCompressor(level=1, write_checksum=True)
        self.width, self.rows = width, []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        frame = self.zip.compress(ids)
        self.out.write(frame)
        wide = np.frombuffer(ids, f"<u{self.width}").astype("<u4")
        self.rows.append((doc_id or 0, doc_id is None, len(wide), len(frame), zlib.crc32(frame), zlib.crc32(wide)))

    def close(self) -> int:
        """Finishes the file; how many ids it has."""
        kinds = ("<i8", "<u1", "<u4", "<u4", "<u4", "<u4")
        columns = [np.array(c, k) for c, k in zip(zip(*self.rows, strict=True), kinds, strict=True)] if self.rows else []
        raw = b"".join(c.tobytes() for c in columns)
        table = self.zip.compress(raw)
        trailer = struct.pack(TRAILER, MAGIC, self.width, len(self.rows), len(table), len(raw), zlib.crc32(raw))
        self.out.write(struct.pack("<II", SKIPPABLE, len(table) + len(trailer)) + table + trailer)
        self.out.close()
        publish(self.fs, self.part, self.path)
        return int(columns[2].sum()) if columns else 0

    def bounds(self) -> tuple[int | None, int | None]:
        """The least and the greatest doc_id, nulls aside."""
        ids = [r[0] for r in self.rows if not r[1]]
        return (min(ids), max(ids)) if ids else (None, None)


class FileReader:
    """Random access to the documents of one file."""

    def __init__(self, path: str):
        import zstandard

        self.fs, self.path = open_fs(path)
        self.file = self.fs.open_input_file(self.path)
        self.unzip = zstandard.ZstdDecompressor()
        size = self.file.size()
        magic, self.width, n, zipped, raw_len, crc = struct.unpack(TRAILER, self.file.read_at(TRAILER_SIZE, size - TRAILER_SIZE))
        if magic != MAGIC:
            raise ValueError(f"{path}: not a token file")
        raw = self.unzip.decompress(self.file.read_at(zipped, size - TRAILER_SIZE - zipped), max_output_size=raw_len) if raw_len else b""
        if zlib.crc32(raw) != crc:
            raise ValueError(f"{path}: the seek table is damaged")
        at, cols = 0, []
        for kind in ("<i8", "<u1", "<u4", "<u4", "<u4", "<u4"):
            cols.append(np.frombuffer(raw, kind, n, at))
            at += n * np.dtype(kind).itemsize
        self.doc_ids, self.nulls, self.counts, self.sizes, self.frame_crcs, self.id_crcs = cols
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes, dtype="<i8")])

    def __len__(self) -> int:
        return len(self.counts)

    def ids(self, i: int) -> np.ndarray:
        """The ids of the file's i-th document; reads and unpacks its frame alone and verifies both checksums."""
        frame = self.file.read_at(int(self.sizes[i]), int(self.offsets[i]))
        return self._unpack(i, frame)

    def _unpack(self, i: int, frame: bytes) -> np.ndarray:
        if zlib.crc32(frame) != self.frame_crcs[i]:
            raise ValueError(f"{self.path}: frame {i} is damaged")
        ids = np.frombuffer(self.unzip.decompress(frame), f"<u{self.width}").astype("<u4")
        if len(ids) != self.counts[i] or zlib.crc32(ids) != self.id_crcs[i]:
            raise ValueError(f"{self.path}: document {i} is damaged")
        return ids

    def __iter__(self) -> Iterator[np.ndarray]:
        """All documents, read in blocks of some MB."""
        i = 0
        while i < len(self):
            j = max(i + 1, int(np.searchsorted(self.offsets, self.offsets[i] + (4 << 20), "right")) - 1)
            block = self.file.read_at(int(self.offsets[j] - self.offsets[i]), int(self.offsets[i]))
            for k in range(i, j):
                a = int(self.offsets[k] - self.offsets[i])
                yield self._unpack(k, block[a : a + int(self.sizes[k])])
            i = j


# --- operators ------------------------------------------------------------------------------------

MANIFEST = "file_no int, path string, docs long, tokens long, least long, most long"


def write_tokens(docs: DataFrame, tokenizer: str, path: str | None = None, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, files: int | None = None) -> DataFrame:
    """Encodes every text and writes the ids as files of the format above, in ascending order of doc_id.

    Returns the manifest, one row for each file: file_no, path, docs, tokens, start (ids in all files
    before it), and least and most, the bounds of its doc_ids. Documents are dealt out by ranges of (doc_id, hash of the text), so no task holds more than
    its range, and a file's name depends on its range only: a task that is run again replaces its own file.

    Nulls: a null text has no words, a null doc_id sorts first. Each repeated row is a document of its
    own. An empty table gives an empty manifest. Other columns are ignored.
    """
    spark = docs.sparkSession
    path = qualified(spark, path or fresh_path(spark, "tokens"))
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    tie = F.xxhash64("text")
    dealt = rows.repartitionByRange(n, F.col("doc_id"), tie).sortWithinPartitions(F.col("doc_id"), tie)
    end = end_id

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        enc, out, file_no = encoder(tokenizer), None, task.partitionId()
        name = f"{path}/{file_no:06d}.tok"
        tail = np.array([end], enc.dtype).tobytes()
        count = 0
        for b in small(batches):
            if out is None:
                out = FileWriter(name, enc.width, str(task.taskAttemptId()))
            for k, ids in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist()), strict=True):
                out.add(k, ids + tail)
            count += b.num_rows
        if out is not None and count:
            # A file of this machine is named plainly, for tools that know no URIs.
            row = (file_no, name.removeprefix("file://"), count, out.close(), *out.bounds())
            kinds = (pa.int32(), pa.string(), *[pa.int64()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=["file_no", "path", "docs", "tokens", "least", "most"])

    made = dealt.mapInArrow(write, MANIFEST)
    made.write.parquet(f"{path}/manifest")
    manifest = spark.read.parquet(f"{path}/manifest")
    # One row for each file: as few rows as the write had tasks.
    files_found = sorted(manifest.collect(), key=lambda r: r.file_no)
    start, listed = 0, []
    for r in files_found:
        listed.append((*r, start))
        start += r.tokens
    return spark.createDataFrame(listed, f"{MANIFEST}, start long")


def read_tokens(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Reads the files of a manifest back: doc_id, start, n_tokens, ids_crc32 and, if asked for, the ids."""
    n = max(1, manifest.count())

    def read(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                reader, start, out = FileReader(row.path), row.start, []
                for i, ids in enumerate(reader):
                    out.append((None if reader.nulls[i] else int(reader.doc_ids[i]), start, len(ids), zlib.crc32(ids), *([ids] if with_ids else [])))
                    start += len(ids)
                    if len(out) == DOCS_PER_FILE:
                        yield frame(out)
                        out = []
                if out:
                    yield frame(out)
        give_back()

    def frame(out: list) -> pd.DataFrame:
        df = pd.DataFrame(out, columns=["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])])
        return df.assign(doc_id=df["doc_id"].astype("Int64"))

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return manifest.repartitionByRange(n, "file_no").mapInPandas(read, schema)


def lookup_tokens(manifest: DataFrame, wanted: list[int]) -> DataFrame:
    """doc_id and ids of the documents whose doc_id is in ``wanted``; all other frames stay packed and unread, and
    files whose bounds hold none of them stay closed."""
    asked = np.array(sorted(set(wanted)), "<i8")

    def find(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                if np.searchsorted(asked, row.least) == np.searchsorted(asked, row.most, "right"):
                    continue
                reader = FileReader(row.path)
                for i in np.flatnonzero(np.isin(reader.doc_ids, asked) & (reader.nulls == 0)).tolist():
                    yield pd.DataFrame({"doc_id": [int(reader.doc_ids[i])], "ids": [reader.ids(i)]})

    return manifest.where("least is not null").mapInPandas(find, "doc_id long, ids array<long>")


def token_output(docs: DataFrame, tokenizer: str, **names: str) -> DataFrame:
    """Writes docs as token files and returns what reading them back gives."""
    return read_tokens(write_tokens(docs, tokenizer, **names))
