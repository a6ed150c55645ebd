"""Token ids in Arrow files of equal-length sequences.

Documents, in ascending id order, form one stream of ids. It is cut into sequences of ``length`` ids
and kept in Arrow IPC files without compression, whose columns are fixed-size lists: ``ids`` and the
``mask`` that is false on padding. Row i of a file is at a place known from i alone, so a reader maps
the file into memory and takes any sequence without reading or copying the rest. Each file has an index
beside it (doc_id, first position, number of ids).

Each Spark partition of the range-partitioned documents (by default as many as the input has splits, if these are
more than the session's shuffle partitions) writes one pair of files under a name of its own attempt; the manifest, a Parquet table, names the attempts that count. A task that is run again or
twice leaves only a file that nothing names.

Texts: null counts as empty; every document ends with ``end_id``, so an empty one has one id. Null ids
come first. Repeated and null ids stay separate documents in an order that their texts decide, and are dealt by it,
so one id may fill several files. Ids may be integers or strings. An empty table gives empty results. Only id and
text are read, so other columns may have any names.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelforge.llm.common import texts_of, work_dir

CACHE_WORDS = 600_000
MANIFEST = "part int, file string, n_docs long, n_tokens long"


class WordEncoder(dict):
    """Encodes with the tokenizers library, each distinct word once.

    Only for tokenizers that drop white space between words, so that words don't see one another. A run
    of Latin letters at the start of a word, before an ASCII character or the end, is encoded apart from
    what follows: such tokenizers always split there. New runs go to the library in one text; each gives
    one token that ends a word, by which the ids are told apart.
    """

    SPLIT = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]++(?=[\x00-\x7f]|\Z)|[^\x20\x09-\x0D]+")
    LETTERS = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")

    def __init__(self, path: str, dtype: str):
        super().__init__()
        self.tokenizer, self.dtype = Tokenizer.from_file(path), np.dtype(dtype)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True

    def learn(self, new: list[str]) -> None:
        letters = self.LETTERS.fullmatch
        runs = [w for w in new if letters(w)]
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(runs)], add_special_tokens=False)[0].ids, self.dtype)
        stops = (np.flatnonzero(self.ends[ids]) + 1) * self.dtype.itemsize
        if len(stops) == len(runs):
            data, start = ids.tobytes(), 0
            for word, stop in zip(runs, stops.tolist(), strict=True):
                self[word] = data[start:stop]
                start = stop
            new = [w for w in new if w not in self]
        for word, found in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self[word] = np.array(found.ids, self.dtype).tobytes()

    def encode_batch(self, texts: list[str], end_id: int) -> list[bytes]:
        out, end = [], np.array([end_id], self.dtype).tobytes()
        start = 0
        while start < len(texts):
            stop, size = start, 0
            while stop < len(texts) and size < 2_000_000:
                size += len(texts[stop])
                stop += 1
            words = [self.SPLIT.findall(t) for t in texts[start:stop]]
            if len(self) > CACHE_WORDS:
                self.clear()
            self.learn([w for w in set().union(*words) if w not in self])
            out += [b"".join(map(self.__getitem__, w)) + end for w in words]
            start = stop
        return out


@lru_cache(maxsize=2)
def _encoder(path: str, dtype: str) -> WordEncoder:
    return WordEncoder(path, dtype)


def id_type(path: str) -> str:
    """The narrowest unsigned type that holds every id of the vocabulary."""
    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"


class SequenceWriter:
    """Writes one pair of files; keeps no more than a batch of sequences in memory."""

    def __init__(self, folder: str, name: str, length: int, dtype: str, id_type: pa.DataType, rows: int = 256):
        self.fs, root = pa.fs.FileSystem.from_uri(folder)
        self.fs.create_dir(root, recursive=True)
        self.length, self.dtype, self.rows, self.held = length, np.dtype(dtype), rows, b""
        kind = pa.from_numpy_dtype(self.dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.index_schema = pa.schema([("doc_id", id_type), ("position", pa.int64()), ("n_tokens", pa.int64())])
        self.outs = [self.fs.open_output_stream(f"{root}/{name}.{end}") for end in ("arrow", "index.arrow")]
        self.files = [pa.ipc.new_file(o, s) for o, s in zip(self.outs, (self.schema, self.index_schema), strict=True)]
        self.n_docs = self.n_tokens = 0

    def add(self, doc_ids: pa.Array, tokens: list[bytes]) -> None:
        sizes = np.array([len(t) // self.dtype.itemsize for t in tokens], dtype=np.int64)
        starts = self.n_tokens + np.cumsum(sizes) - sizes
        self.files[1].write_batch(pa.RecordBatch.from_arrays([doc_ids, pa.array(starts), pa.array(sizes)], schema=self.index_schema))
        self.n_docs, self.n_tokens = self.n_docs + len(sizes), self.n_tokens + int(sizes.sum())
        self._cut(self.held + b"".join(tokens), self.length * self.rows * self.dtype.itemsize)

    def _cut(self, data: bytes, step: int) -> None:
        whole = len(data) // step * step
        for at in range(0, whole, step):
            self._write(np.frombuffer(data[at : at + step], self.dtype))
        self.held = data[whole:]

    def _write(self, ids: np.ndarray) -> None:
        padded = np.zeros(-(-len(ids) // self.length) * self.length, self.dtype)
        padded[: len(ids)] = ids
        mask = np.arange(len(padded)) < len(ids)
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (padded, mask)]
        self.files[0].write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        if self.held:
            self._write(np.frombuffer(self.held, self.dtype))
        for f, o in zip(self.files, self.outs, strict=True):
            f.close()
            o.close()


class SequenceFile:
    """Random access to the sequences of one file."""

    def __init__(self, folder: str, name: str):
        fs, root = pa.fs.FileSystem.from_uri(folder)
        self.batches = self._open(fs, f"{root}/{name}.arrow")
        self.index = self._open(fs, f"{root}/{name}.index.arrow").read_all()
        self.rows = self.batches.get_batch(0).num_rows if self.batches.num_record_batches else 1

    @staticmethod
    def _open(fs: pa.fs.FileSystem, path: str) -> pa.ipc.RecordBatchFileReader:
        local = isinstance(fs, pa.fs.LocalFileSystem)
        return pa.ipc.open_file(pa.memory_map(path) if local else fs.open_input_file(path))

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (a view of the mapped file) and mask of sequence i."""
        batch = self.batches.get_batch(i // self.rows)
        ids, mask = (batch.column(c)[i % self.rows].values for c in (0, 1))
        return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """doc_id, position in the file, and ids of each document, a few batches at a time."""
        ids, first, batch = None, 0, 0
        for doc, position, n in zip(*(c.to_pylist() for c in self.index.columns), strict=True):
            while ids is None or first + len(ids) < position + n:
                more = self.batches.get_batch(batch).column(0).flatten().to_numpy()
                keep = 0 if ids is None else min(len(ids), position - first)
                ids = more if ids is None else np.concatenate([ids[keep:], more])
                first, batch = first + keep, batch + 1
            yield doc, position, ids[position - first : position - first + n]


def write_token_files(
    docs: DataFrame, tokenizer_path: str, folder: str, end_id: int, length: int = 2048, text_col: str = "text", id_col: str = "doc_id", partitions: int | None = None
) -> DataFrame:
    """Write all documents below ``folder`` and return the manifest (part, file, n_docs, n_tokens), ordered by part."""
    spark, dtype = docs.sparkSession, id_type(tokenizer_path)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, name, part = _encoder(tokenizer_path, dtype), None, "", 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                part = batch.column(2)[0].as_py()
                name = f"part-{part:06d}-{uuid.uuid4().hex}"
                writer = SequenceWriter(f"{folder}/sequences", name, length, dtype, batch.column(0).type)
            writer.add(batch.column(0), encoder.encode_batch(texts_of(batch.column(1)), end_id))
        if writer is not None:
            writer.close()
            row = [[part], [name], [writer.n_docs], [writer.n_tokens]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["part", "file", "n_docs", "n_tokens"])

    order = [F.col("__id"), F.xxhash64("__text")]
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    dealt.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_token_files(manifest: DataFrame, folder: str, id_type: str = "long") -> DataFrame:
    """doc_id (of SQL type ``id_type``), start, n_tokens and ids_crc32 of every document, read back from the files.

    One manifest row stands for a whole file, so what the driver adds up here is one number a file.
    """
    spark = manifest.sparkSession
    starts, total = [], 0
    for part, file, tokens in sorted((r.part, r.file, r.n_tokens) for r in manifest.collect()):
        starts.append((file, total))
        total += tokens

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sequences = SequenceFile(f"{folder}/sequences", file)
                found = [(doc, start + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for doc, at, ids in sequences.documents()]
                types = [sequences.index.schema.field(0).type, *[pa.int64()] * 3]
                columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    listed = spark.createDataFrame(starts, "file string, start long").repartition(max(1, len(starts)))
    return listed.mapInArrow(read, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def token_file_index(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None, **kwargs) -> DataFrame:
    """Write the files (by default to the shared work folder) and return what reading them back shows."""
    folder = folder or work_dir(docs.sparkSession, "token-files")
    id_type = docs.schema[kwargs.get("id_col", "doc_id")].dataType.simpleString()
    return read_token_files(write_token_files(docs, tokenizer_path, folder, end_id, **kwargs), folder, id_type)
