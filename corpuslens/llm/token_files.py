"""Token ids in Arrow files of equal-length sequences.

Each range of ids goes to one Arrow IPC file (the stream format with a footer, so that any batch can be
reached). A file holds its documents' ids end to end, each closed by an end id, cut into fixed-size lists of
``length``: column ``ids`` (16-bit if the vocabulary allows) and column ``mask`` (true for a real id). Only a
file's last sequence is padded. Batches hold ``BATCH`` sequences, so a document's ids are found from its
offset alone and read without a copy. Files are written under another name and then renamed, so a lost or
repeated task leaves no half file.

Encoding uses the tokenizers library, by the distinct stretches of groups of texts (``words``).

Defined results: null text counts as empty and gives the end id alone; rows go by ascending id, those of
equal id by text; a null id comes first; a very long text is encoded whole, in a group of its own; an empty
table gives no files and no rows; extra columns are not read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm import words
from corpuslens.llm.common import new_path, staged
from corpuslens.llm.words import Runs

LENGTH, BATCH = 2048, 64
#: Stretches that the library encodes as one text.
JOINED = 1024


class LibraryEncoder:
    """The tokenizers library, for distinct stretches of text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.starts = np.zeros(size, dtype=bool)  # ids that begin with a space
        for token, i in self.library.get_vocab(with_added_tokens=True).items():
            self.starts[i] = token.startswith("Ġ")
        # second bytes that may belong to white space
        self.odd = np.isin(np.arange(256), [*range(9, 14), 32, 0xC2, 0xE1, 0xE2, 0xE3])

    def _all(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, dtype=self.dtype) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_words(self, distinct: pa.StringArray) -> Runs:
        """Ids of each stretch: those of one space and a word many in one text, the others each alone."""
        data, edges = words.buffers(distinct)
        first = edges[:-1]
        plain = (np.diff(edges) > 1) & (data[first] == 32) & ~self.odd[data[np.minimum(first + 1, len(data) - 1)]] if len(data) else np.zeros(len(distinct), bool)
        chosen = distinct.filter(pa.array(plain))
        data, edges = words.buffers(chosen)
        edges = [*edges[:-1:JOINED].tolist(), int(edges[-1])]
        parts, where = [], np.flatnonzero(plain)
        for k, ids in enumerate(self._all([data[a:b].tobytes().decode() for a, b in zip(edges[:-1], edges[1:], strict=True)])):
            own = where[k * JOINED : (k + 1) * JOINED]
            begins = np.flatnonzero(self.starts[ids])
            if len(begins) == len(own):  # always so by the pattern's rules; else each by itself
                parts.append((own, Runs(ids, begins, np.diff(np.append(begins, len(ids))))))
            else:
                plain[own] = False
        rest = np.flatnonzero(~plain)
        alone = self._all(distinct.take(pa.array(rest)).to_pylist())
        parts.append((rest, Runs.of(np.concatenate([np.zeros(0, self.dtype), *alone]), np.array([len(x) for x in alone], np.int64))))
        return Runs.placed(len(distinct), parts)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        ids, edges = words.encode([t or "" for t in texts], self.encode_words)
        raw, at = ids.tobytes(), (edges * self.dtype.itemsize).tolist()
        return [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


_ENCODERS: dict[str, LibraryEncoder] = {}


def encoder(path: str) -> LibraryEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = LibraryEncoder(path)
    return _ENCODERS[path]


class SequenceWriter:
    """Packs ids into sequences and writes them to one Arrow file."""

    def __init__(self, uri: str, name: str, dtype: np.dtype, length: int):
        self.fs, root = pafs.FileSystem.from_uri(uri)
        self.fs.create_dir(root, recursive=True)
        self.final, self.temp = f"{root}/{name}", f"{root}/_{name}.{os.getpid()}.{id(self):x}"
        self.dtype, self.length = dtype, length
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out = self.fs.open_output_stream(self.temp)
        self.writer = pa.ipc.new_file(self.out, self.schema)
        self.parts, self.held, self.total = [], 0, 0

    def add(self, raw: bytes) -> None:
        self.parts.append(raw)
        n = len(raw) // self.dtype.itemsize
        self.held += n
        self.total += n
        if self.held >= self.length * BATCH:
            ids = np.frombuffer(b"".join(self.parts), self.dtype)
            step = self.length * BATCH
            whole = len(ids) // step * step
            for at in range(0, whole, step):
                self._write(ids[at : at + step], step)
            self.parts, self.held = [ids[whole:].tobytes()], len(ids) - whole

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = pa.array(np.arange(len(ids)) < real)
        self.writer.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(ids), self.length), pa.FixedSizeListArray.from_arrays(mask, self.length)], schema=self.schema))

    def close(self) -> None:
        if self.held:
            ids = np.frombuffer(b"".join(self.parts), self.dtype)
            padded = np.zeros(-(-len(ids) // self.length) * self.length, self.dtype)
            padded[: len(ids)] = ids
            self._write(padded, len(ids))
        self.writer.close()
        self.out.close()
        self.fs.move(self.temp, self.final)


class SequenceReader:
    """Random access to one file: ``ids(start, n)`` counts real ids from the file's begin."""

    def __init__(self, uri: str, name: str):
        self.fs, root = pafs.FileSystem.from_uri(uri)
        path = f"{root}/{name}"
        self.source = pa.memory_map(path) if isinstance(self.fs, pafs.LocalFileSystem) else self.fs.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("ids").type.list_size
        self.at, self.held = -1, None

    def batch(self, k: int) -> np.ndarray:
        if self.at != k:
            self.at, self.held = k, self.file.get_batch(k).column(0).flatten().to_numpy(zero_copy_only=True)
        return self.held

    def ids(self, start: int, n: int) -> np.ndarray:
        step, out = self.length * BATCH, []
        while n:
            k, inside = divmod(start, step)
            part = self.batch(k)[inside : inside + n]
            out.append(part)
            start, n = start + len(part), n - len(part)
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.uint16)


def write_token_files(docs: DataFrame, tokenizer: str, out: str, end_id: int = 2, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files; returns their index, staged: id, file (number), at (ids before it in the file), n_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        number, writer = TaskContext.get().partitionId(), None
        end = np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            if not batch.num_rows:
                continue
            writer = writer or SequenceWriter(out, f"tokens-{number:06d}.arrow", enc.dtype, length)
            at, n = [], []
            for texts in words.groups(batch.column(1)):
                for raw in enc.encode(texts):
                    raw += end
                    at.append(writer.total)
                    n.append(len(raw) // enc.dtype.itemsize)
                    writer.add(raw)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([number] * len(n), pa.int32()), pa.array(at, pa.int64()), pa.array(n, pa.int64())], ["id", "file", "at", "n_tokens"])
        if writer:
            writer.close()
        pa.default_memory_pool().release_unused()  # the worker process lives on

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.selectExpr(f"`{id_col}` AS id", f"CAST(`{text_col}` AS string) AS text")
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    return staged(ordered.mapInArrow(run, f"id {kind}, file int, at long, n_tokens long"), "token-index")


def read_documents(index: DataFrame, out: str) -> DataFrame:
    """Each document's place and the checksum of its ids as read from the files: id, start, n_tokens, ids_crc32."""
    per_file = index.groupBy("file").agg(F.sum("n_tokens").alias("ids"))
    # one row per file
    first = per_file.select("file", (F.sum("ids").over(Window.orderBy("file")) - F.col("ids")).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, current = None, None
        for batch in batches:
            crc = []
            files, starts, counts = (batch.column(k).to_pylist() for k in (1, 2, 3))
            for f, at, n in zip(files, starts, counts, strict=True):
                if f != current:
                    reader, current = SequenceReader(out, f"tokens-{f:06d}.arrow"), f
                crc.append(zlib.crc32(reader.ids(at, n).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(crc, pa.int64())], ["id", "file", "at", "n_tokens", "ids_crc32"])

    schema = index.schema.simpleString()[7:-1] + ",ids_crc32:bigint"
    read = index.mapInArrow(run, schema.replace(":", " "))
    return read.join(F.broadcast(first), "file").select("id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_file_round_trip(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    out = new_path(docs.sparkSession, "tokens")
    return read_documents(write_token_files(docs, tokenizer, out, **options), out)
