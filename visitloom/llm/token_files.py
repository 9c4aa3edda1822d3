"""Token ids in Arrow files of equal-length sequences.

Documents are range-partitioned and sorted by id, so each task encodes one run of ids and
writes it as Arrow IPC files: batches of fixed-size lists ``ids`` (one packed sequence each)
and ``mask`` (true for tokens, false for the padding of a file's last sequence), beside an
index file with doc_id, start and n_tokens. Sequences lie back to back in a batch, so a
memory-mapped file gives any sequence or mask without a copy. Files get their final name only
when complete, and the name depends on the partition alone: a task that runs again after a
lost executor replaces its own file.

Encoding is memoised by word. A byte-level vocabulary never merges across the pieces into which
its own rule splits a text, so the tokenizers library encodes each piece once and later
occurrences are looked up; this holds for files that state that rule and no normaliser, and any
other file's texts are encoded whole. Texts beyond Latin letters and printable ASCII are split only before a space that a
visible character follows, where a piece begins whatever stands around; texts that hold an added
token are encoded whole.

Defined results: null text is empty and yields the end id alone; null ids come first; rows
with equal ids keep each its own entry, in the order of a hash of their texts, which also parts
them between tasks if one id is on very many rows; an empty table writes no files; further
columns are not read, so names cannot clash; a very long text is encoded whole and its ids lie
across as many sequences as they need.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import ChainMap
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from visitloom.llm.common import Scratch
from visitloom.session import ship

SEQUENCE = 2048
BATCH = 128  # sequences in a record batch
FILE_TOKENS = 1 << 26
END = 0
WORDS_KEPT = 1_000_000

_encoders: dict[str, Encoder] = {}


class Encoder:
    """The tokenizers library with a bounded memory of words."""

    _letters = "A-Za-zÀ-ÖØ-öø-ɏ"
    #: the vocabulary's own splitting rule, on texts of these letters and printable ASCII
    _plain_pieces = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_letters}]+| ?[0-9]+| ?[^\s{_letters}0-9]+|\s+(?!\S)|\s+")
    _not_plain = re.compile(rf"[^\t\n\r -~{_letters}]")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = _dtype(self.tokenizer.get_vocab_size())
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_pieces = _splits_as_known(self.tokenizer)
        self.known: dict[str, bytes] = {}

    @classmethod
    def at(cls, path: str) -> Encoder:
        """One for each worker process, so its memory serves all its tasks."""
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def _pieces(self, text: str) -> list[str]:
        """Pieces of a text whose ids, one after another, are the ids of the text."""
        if not self.by_pieces or any(a in text for a in self.added):
            return [text]
        if not self._not_plain.search(text):
            return self._plain_pieces.findall(text)
        # a space before a visible character always begins a piece
        first, *rest = text.split(" ")
        out = [first]
        for w in rest:
            if w and ("!" <= w[0] <= "~" or w[0].isalnum()):
                out.append(" " + w)
            else:
                out[-1] += " " + w
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        pieces = [self._pieces(t) for t in texts]
        known = self.known
        new = list(dict.fromkeys(w for ws in pieces for w in ws if w not in known))
        fresh: dict[str, bytes] = {}
        for lo in range(0, len(new), 4096):
            part = new[lo : lo + 4096]
            done = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            fresh.update((w, np.array(e.ids, self.dtype).tobytes()) for w, e in zip(part, done, strict=True))
        look = known
        if len(known) + len(fresh) <= WORDS_KEPT:
            known.update((w, b) for w, b in fresh.items() if len(w) < 64)
        if len(known) + len(fresh) > WORDS_KEPT or any(len(w) >= 64 for w in fresh):
            look = ChainMap(fresh, known)
        return [np.frombuffer(b"".join(map(look.__getitem__, ws)), self.dtype) for ws in pieces]


def _splits_as_known(tokenizer) -> bool:
    """Whether the file states the byte-level splitting rule that ``Encoder`` knows, and nothing else."""
    stated = json.loads(tokenizer.to_str())
    rule = stated.get("pre_tokenizer") or {}
    known = rule.get("type") == "ByteLevel" and rule.get("use_regex", True) and not rule.get("add_prefix_space")
    plain = not any(stated.get(k) for k in ("normalizer", "post_processor", "truncation", "padding"))
    # added tokens that strip spaces around them or match within a normalised text are found whole only
    return known and plain and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in stated.get("added_tokens", []))


class _File:
    """One file of sequences and its index, while they are written."""

    def __init__(self, folder: str, name: str, length: int, dtype):
        self.fs, self.folder = pa.fs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.name, self.length, self.dtype = name, length, dtype
        self.unique = os.urandom(8).hex()
        self.ids_type = pa.list_(pa.from_numpy_dtype(dtype), length)
        self.mask_type = pa.list_(pa.bool_(), length)
        self.schema = pa.schema([("ids", self.ids_type), ("mask", self.mask_type)])
        self.out = self.fs.open_output_stream(self._temporary("arrow"))
        self.writer = pa.ipc.new_file(self.out, self.schema)
        self.docs: list[tuple[int | None, int, int]] = []
        self.pending: list[np.ndarray] = []
        self.held = self.tokens = 0

    def _temporary(self, kind: str) -> str:
        return f"{self.folder}/.{self.name}.{kind}.{self.unique}"

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, self.tokens, len(ids)))
        self.pending.append(ids.astype(self.dtype))
        self.held += len(ids)
        self.tokens += len(ids)
        if self.held >= self.length * BATCH:
            self._write(self.held // self.length * self.length)

    def _write(self, n: int) -> None:
        flat = np.concatenate(self.pending) if self.pending else np.zeros(0, self.dtype)
        now, rest = flat[:n], flat[n:]
        for lo in range(0, n, self.length * BATCH):
            part = now[lo : lo + self.length * BATCH]
            self._batch(part, len(part))
        self.pending, self.held = [rest], len(rest)

    def _batch(self, flat: np.ndarray, filled: int) -> None:
        mask = np.arange(len(flat)) < filled
        self.writer.write_batch(
            pa.RecordBatch.from_arrays(
                [pa.FixedSizeListArray.from_arrays(pa.array(flat), type=self.ids_type), pa.FixedSizeListArray.from_arrays(pa.array(mask), type=self.mask_type)],
                schema=self.schema,
            )
        )

    def close(self) -> dict:
        self._write(self.held // self.length * self.length)
        if self.held:
            last = np.concatenate(self.pending)
            self._batch(np.concatenate([last, np.zeros(self.length - len(last), self.dtype)]), len(last))
        self.writer.close()
        self.out.close()
        index = pa.table(
            [pa.array([d[k] for d in self.docs], pa.int64()) for k in range(3)], names=["doc_id", "start", "n_tokens"]
        )
        with self.fs.open_output_stream(self._temporary("index")) as out, pa.ipc.new_file(out, index.schema) as w:
            w.write_table(index, max_chunksize=1 << 16)
        for kind in ("index", "arrow"):
            self.fs.move(self._temporary(kind), f"{self.folder}/{self.name}.{kind}")
        return {"name": self.name, "docs": len(self.docs), "tokens": self.tokens}


def _dtype(vocabulary: int):
    return np.uint16 if vocabulary <= 1 << 16 else np.uint32


def write(documents: DataFrame, tokenizer: str, folder: str, length: int = SEQUENCE, end: int = END) -> DataFrame:
    """Write the files; returns their manifest rows (name, docs, tokens). ``folder`` is a URI."""
    ship(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    rows = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.at(tokenizer)
        dtype = encoder.dtype
        part, number, file, done = TaskContext.get().partitionId(), 0, None, []
        for batch in batches:
            for lo in range(0, len(batch), 64):
                some = batch.slice(lo, 64)
                texts = [t or "" for t in some.column(1).to_pylist()]
                for doc_id, ids in zip(some.column(0).to_pylist(), encoder.encode(texts), strict=True):
                    if file is None:
                        file = _File(folder, f"part-{part:06d}-{number:04d}", length, dtype)
                    file.add(doc_id, np.append(ids, dtype(end)))
                    if file.tokens >= FILE_TOKENS:
                        done.append(file.close())
                        file, number = None, number + 1
        if file is not None:
            done.append(file.close())
        if done:
            yield pa.RecordBatch.from_pylist(done, pa.schema([("name", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]))

    return rows.mapInArrow(task, "name string, docs long, tokens long")


def open_file(folder: str, name: str):
    """Random-access reader of a file; memory-mapped where the store is a local disk."""
    fs, path = pa.fs.FileSystem.from_uri(folder)
    at = f"{path}/{name}"
    return pa.ipc.open_file(pa.memory_map(at) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(at))


def _documents(folder: str, name: str) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, start, ids) of a file, holding one batch and one document at a time."""
    tokens, index = open_file(folder, f"{name}.arrow"), open_file(folder, f"{name}.index")
    k, base, flat = -1, 0, np.zeros(0, np.uint16)
    for b in range(index.num_record_batches):
        batch = index.get_batch(b)
        for doc_id, start, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            pieces, at = [], start
            while at < start + n:
                while at >= base + len(flat):
                    base += len(flat)
                    k += 1
                    flat = tokens.get_batch(k).column(0).flatten().to_numpy(zero_copy_only=True)
                pieces.append(flat[at - base : start + n - base])
                at += len(pieces[-1])
            yield doc_id, start, np.concatenate(pieces)


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files of a manifest.

    ``start`` counts the ids of all documents before, over all files in the order of names.
    """
    ship(manifest.sparkSession)
    before = W.orderBy("name").rowsBetween(W.unboundedPreceding, -1)  # a row for each file
    placed = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    placed = placed.select("name", "base").repartition(manifest.sparkSession.sparkContext.defaultParallelism * 2)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                rows = []
                for doc_id, start, ids in _documents(folder, name):
                    rows.append((doc_id, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

    return placed.mapInArrow(task, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_and_read_back(documents: DataFrame, tokenizer: str, folder: str | None = None, scratch: Scratch | None = None) -> DataFrame:
    """Write the files of all documents, then tell each document's digest from the files."""
    scratch = scratch or Scratch(documents.sparkSession, "tokens")
    folder = folder or scratch.path("files")
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    manifest = scratch.save(write(documents, tokenizer, folder), "manifest")
    return read(manifest, folder)
