"""Token ids as flat binary files: one pair of files per range of doc_id, written by tasks, read back memory-mapped.

``<shard>.bin`` holds the ids of its documents one after the other as little-endian unsigned integers of 2 or 4 bytes,
``<shard>.idx`` a header, the 64-bit offset of every document and its doc_id. Shards follow each other in doc_id order; the
first id of a shard in the whole corpus is the sum of the ids of the shards before it, taken over the manifest, which has
one row per shard.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir, stage, text_or_empty

MAGIC = b"TOKIDX01"
#: magic, bytes per id, documents
HEADER = "<8sQQ"
#: Chunks of text that a generation of the memory holds.
REMEMBERED = 600_000
#: Characters that are cut into chunks at a time.
CHARS_AT_ONCE = 1_500_000

#: Marks that end words; none of them is a letter, a digit or white space.
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "¡¿«»„“”‘’…–—"


#: Stands for the ids of a chunk that the space behind it does not end.
OPEN = False


class _Memory(dict):
    """Ids by chunk in two generations: what a full one is asked for again moves on, the rest is forgotten."""

    def __init__(self) -> None:
        super().__init__()
        self.old: dict[str, bytes | bool] = {}

    def age(self) -> None:
        if len(self) > REMEMBERED:
            self.old = dict(self)
            self.clear()

    def fresh(self, chunks: Iterable[str]) -> list[str]:
        """Those of some chunks, none of them in this generation, that the one before does not know either."""
        unknown, old = [], self.old
        for c in dict.fromkeys(chunks):
            ids = old.get(c)
            if ids is None:
                unknown.append(c)
            else:
                self[c] = ids
        return unknown


class Encoder:
    """The tokenizers library with a memory of chunks: byte-level BPE never merges across the space before a word."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        rule = str(self.tokenizer.pre_tokenizer)
        self.chunked = "ByteLevel(add_prefix_space=False" in rule and "use_regex=True" in rule and self.tokenizer.normalizer is None
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.bare, self.spaced = _Memory(), _Memory()
        self.line_break = self._ids(["\n"])[0]

    def _ids(self, texts: list[str]) -> list[bytes]:
        dtype = f"<u{self.width}"
        return [np.array(e.ids, dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Words of letters behind a space, encoded as one text and cut apart again."""
        if not words:
            return []
        found = self.tokenizer.encode(" " + " ".join(words), add_special_tokens=False)
        ids, word = np.array(found.ids, f"<u{self.width}"), np.array(found.word_ids)
        cuts = np.searchsorted(word, np.arange(len(words) + 1)).tolist()
        raw, w = ids.tobytes(), self.width
        return [raw[a * w:b * w] for a, b in zip(cuts, cuts[1:])]

    def _lines(self, words: list[str]) -> list[bytes]:
        """Words of letters without a space before them, encoded as the lines of one text."""
        if not words:
            return []
        found = self.tokenizer.encode("\n".join(words), add_special_tokens=False)
        ids, word = np.array(found.ids, f"<u{self.width}"), np.array(found.word_ids)
        starts = np.searchsorted(word, 2 * np.arange(len(words))).tolist()
        ends = np.searchsorted(word, 2 * np.arange(len(words)) + 1).tolist()
        raw, w = ids.tobytes(), self.width
        return [raw[a * w:b * w] for a, b in zip(starts, ends, strict=True)]

    def _learn(self, memory: _Memory, chunks: Iterable[str], before: str) -> dict[str, bytes]:
        """Remember the ids of chunks that are not in the memory; OPEN for those that the space after them does not end.

        Words around a line break are remembered on their own; the ids of the chunk they make are only handed back.
        """
        fresh, once = memory.fresh(chunks), {}
        words = [c for c in fresh if c.isalpha()]
        memory.update(zip(words, self._words(words) if before else self._lines(words), strict=True))
        if len(words) == len(fresh):
            return once
        rest, broken, ended = [], [], []
        for c in fresh:
            if c.isalpha():
                continue
            if not c or c[-1].isspace():
                memory[c] = OPEN
            elif "\n" in c and all(p and not p[0].isspace() and not p[-1].isspace() for p in c.split("\n")):
                broken.append((c, c.split("\n")))  # a line break between two visible characters is a chunk of its own
            elif (head := c.rstrip(_MARKS)) != c and head.isalpha():
                ended.append((c, head, c[len(head):]))  # letters and marks never merge
            else:
                rest.append(c)
        heads = [p[0] for _, p in broken if p[0] not in memory]
        heads += [h for _, h, _ in ended if h not in memory]
        if heads:
            self._learn(memory, heads, before)
        bare = self.bare
        tails = [x for _, p in broken for x in p[1:] if x not in bare]
        tails += [t for _, _, t in ended if t not in bare]
        if tails:
            self._learn(bare, tails, "")
        for c, head, tail in ended:
            memory[c] = memory[head] + bare[tail]
        for c, parts in broken:
            once[c] = self.line_break.join([memory[parts[0]], *[bare[p] for p in parts[1:]]])
        memory.update(zip(rest, self._ids([before + c for c in rest]), strict=True))
        return once

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as bytes."""
        out: list[bytes | None] = [None] * len(texts)
        if self.chunked:
            self.bare.age()
            self.spaced.age()
            bare, spaced, known = self.bare, self.spaced, self.spaced.get
            firsts, parts, gaps, unknown = [], [], [], []
            for text in texts:
                first, *chunks = text.split(" ")
                ids = list(map(known, chunks))
                holes = [k for k, v in enumerate(ids) if v is None]
                gaps.append([(k, chunks[k]) for k in holes])
                unknown += [c for _, c in gaps[-1]]
                firsts.append(first)
                parts.append(ids)
            starts = self._learn(bare, [f for f in firsts if f not in bare], "")
            once = self._learn(spaced, unknown, " ")
            for i, (first, ids, holes) in enumerate(zip(firsts, parts, gaps, strict=True)):
                for k, c in holes:
                    ids[k] = once[c] if c in once else spaced[c]
                try:
                    out[i] = (starts[first] if first in starts else bare[first] if first else b"") + b"".join(ids)
                except TypeError:  # an open chunk: white space of more than one space somewhere
                    pass
        whole = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(whole, self._ids([texts[i] for i in whole]), strict=True):
            out[i] = ids
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """doc_ids and texts, about CHARS_AT_ONCE characters at a time."""
    for batch in batches:
        ids, texts, size = [], [], 0
        for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids.append(d)
            texts.append(t.as_py())
            size += len(texts[-1])
            if size >= CHARS_AT_ONCE:
                yield ids, texts
                ids, texts, size = [], [], 0
        if ids:
            yield ids, texts


def _writer(folder: str, tokenizer: str, end_id: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        part = TaskContext.get().partitionId()
        # another attempt writes other files; only those of the attempt that counts are in the manifest
        path = f"{folder}/shard-{part:06d}-{uuid.uuid4().hex}"
        store, base = _filesystem(path)
        end = np.array([end_id], f"<u{coder.width}").tobytes()
        ids: list[int | None] = []
        sizes: list[int] = []
        with store.open_output_stream(f"{base}.bin") as out:
            for some, texts in _rows(batches):
                encoded = coder.encode(texts)
                ids += some
                sizes += [len(e) // coder.width + 1 for e in encoded]
                out.write(end.join(encoded) + end)
        offsets = np.concatenate(([0], np.cumsum(sizes))).astype("<u8")
        with store.open_output_stream(f"{base}.idx") as out:
            out.write(struct.pack(HEADER, MAGIC, coder.width, len(ids)) + offsets.tobytes()
                      + np.array([i or 0 for i in ids], "<i8").tobytes() + np.array([i is not None for i in ids], np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([path]), pa.array([len(ids)], pa.int64()), pa.array([int(offsets[-1])], pa.int64())],
                                         ["part", "path", "documents", "tokens"])

    return run


class Shard:
    """One shard, mapped into memory where the file system is local."""

    def __init__(self, path: str):
        store, base = _filesystem(path)
        with store.open_input_file(f"{base}.idx") as file:
            raw = file.read()
        magic, width, n = struct.unpack_from(HEADER, raw)
        if magic != MAGIC:
            raise ValueError(f"{path} is no token file")
        self.offsets = np.frombuffer(raw, "<u8", n + 1, struct.calcsize(HEADER)).astype(np.int64)
        known = np.frombuffer(raw, np.uint8, n, struct.calcsize(HEADER) + 16 * n + 8)
        self.doc_ids = [i if k else None for i, k in zip(np.frombuffer(raw, "<i8", n, struct.calcsize(HEADER) + 8 * n + 8).tolist(), known.tolist(), strict=True)]
        self.dtype = np.dtype(f"<u{width}")
        self.file, self.mapped = None, None
        if isinstance(store, fs.LocalFileSystem):
            self.mapped = np.memmap(f"{base}.bin", self.dtype, "r") if self.offsets[-1] else np.empty(0, self.dtype)
        else:
            self.file = store.open_input_file(f"{base}.bin")

    def ids(self, k: int) -> np.ndarray:
        a, b = int(self.offsets[k]), int(self.offsets[k + 1])
        if self.mapped is not None:
            return self.mapped[a:b]
        return np.frombuffer(self.file.read_at((b - a) * self.dtype.itemsize, a * self.dtype.itemsize), self.dtype)


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0) -> DataFrame:
    """Write the ids of every text, each followed by ``end_id``, and return the manifest (part, path, documents, tokens, base).

    Documents go to shards by ranges of doc_id and are ascending inside them, rows without doc_id first, equal ids by
    text. NULL texts are empty. The manifest is a table in the shared folder.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    shards = stage(rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(
        _writer(folder, tokenizer, end_id), "part int, path string, documents long, tokens long"), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files of a manifest."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(path)
                crc = [zlib.crc32(shard.ids(k).astype("<u4").tobytes()) for k in range(len(shard.doc_ids))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.doc_ids, pa.int64()), pa.array(base + shard.offsets[:-1]), pa.array(np.diff(shard.offsets)), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])

    shards = manifest.filter("documents > 0").select("path", "base")
    return shards.repartition(max(shards.count(), 1)).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write the token files into a new place in the shared folder and describe them from what was read back."""
    folder = f"{ensure_checkpoint_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    store, base = _filesystem(folder)
    store.create_dir(base, recursive=True)
    return read_token_files(write_token_files(docs, tokenizer, folder, end_id))
