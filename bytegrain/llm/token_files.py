"""Token ids in bit-packed files.

File format (little-endian), one file for each range of documents:

    "BGT1" | version 1 | bits an id | ids a block | documents | ids | blocks    (struct HEADER)
    blocks + 1 int64: offset of each block in the packed part, in bytes
    documents int64: id of each document (NULL_ID where it is null)
    documents + 1 int64: first id of each document, counted in the file
    packed ids: each block starts at a byte; an id takes `bits` bits, lowest bit first

`bits` is the fewest that hold the vocabulary. A block holds a fixed number of
ids, so any id is found by arithmetic, and a block unpacks in a few numpy calls.

Texts are dealt out by ranges of (id, hash of text) and each task sorts its range
and writes one file through pyarrow's file systems, under a temporary name that is
then moved: a task that runs twice leaves whole files, of which the rows returned name one. Files lie in the shared
folder; readers open them there. The only thing that meets on the driver is one
count for each file.

Encoding cuts a text before each white space that follows a non-space (a byte-level
BPE with the usual word pattern never joins across it), encodes each distinct piece
once through the tokenizers library, and keeps a bounded cache of pieces.

Defined results: a null or empty text has no ids but the end id; documents are in
ascending id order, null ids first, equal ids by hash of text and then text; rows
equal in both are written each for itself; an empty table writes no file.
"""

from __future__ import annotations

import array
import functools
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bytegrain.llm._shared import bounded_batches, new_path, partitions_for, stored
from bytegrain.llm._words import SPACES, freed, texts

HEADER = struct.Struct("<4sIIIqqq")
_ASCII_SPACE = frozenset(" \t\n\r\v\f")
MAGIC, BLOCK, NULL_ID = b"BGT1", 1 << 14, -(1 << 63)


# --- bit packing ---------------------------------------------------------------


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids (below 2**bits) as a bit string, lowest bit first."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    spread = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes | np.ndarray, bits: int, n: int) -> np.ndarray:
    """The first n ids of a packed block."""
    raw = np.frombuffer(data, np.uint8)
    if bits == 16:
        return raw[: 2 * n].view("<u2").astype(np.uint32)
    spread = np.unpackbits(raw, count=n * bits, bitorder="little").reshape(n, bits)
    return spread.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


def encode_file(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, bits: int, block: int = BLOCK) -> bytes:
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    packed = [pack(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    return b"".join([
        HEADER.pack(MAGIC, 1, bits, block, len(doc_ids), len(ids), len(packed)),
        np.concatenate(([0], np.cumsum([len(x) for x in packed], dtype=np.int64))).astype("<i8").tobytes(),
        np.array([NULL_ID if x is None else x for x in doc_ids], "<i8").tobytes(),
        np.concatenate(([0], np.cumsum(lengths))).astype("<i8").tobytes(),
        *packed,
    ])


class TokenFile:
    """Random access to a file of encode_file(): ids(i) are document i's ids, read from the blocks that hold them."""

    def __init__(self, file: pa.NativeFile):
        self.file = file
        magic, version, self.bits, self.block, n, self.n_ids, blocks = HEADER.unpack(file.read_at(HEADER.size, 0))
        if magic != MAGIC or version != 1:
            raise ValueError("not a token file")
        tables = np.frombuffer(file.read_at(8 * (blocks + 1 + n + n + 1), HEADER.size), "<i8")
        self.offsets, self.doc_ids, self.starts = np.split(tables, [blocks + 1, blocks + 1 + n])
        self.base = HEADER.size + tables.nbytes

    def __len__(self) -> int:
        return len(self.doc_ids)

    def slice(self, first: int, last: int) -> np.ndarray:
        """Ids first..last-1 of the file."""
        if first >= last:
            return np.zeros(0, np.uint32)
        a, b = first // self.block, (last - 1) // self.block
        raw = np.frombuffer(self.file.read_at(int(self.offsets[b + 1] - self.offsets[a]), self.base + int(self.offsets[a])), np.uint8)
        parts = [unpack(raw[self.offsets[k] - self.offsets[a] : self.offsets[k + 1] - self.offsets[a]], self.bits, min(self.block, self.n_ids - k * self.block)) for k in range(a, b + 1)]
        return np.concatenate(parts)[first - a * self.block : last - a * self.block]

    def ids(self, i: int) -> np.ndarray:
        return self.slice(int(self.starts[i]), int(self.starts[i + 1]))


# --- encoding ------------------------------------------------------------------


@functools.cache
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def _token_bytes(path: str) -> np.ndarray:
    """Bytes of each id: a byte-level token's name has a character a byte; an added token stands for its own text."""
    tokenizer = _tokenizer(path)
    out = np.zeros(tokenizer.get_vocab_size(with_added_tokens=True), np.int64)
    for name, id in tokenizer.get_vocab(with_added_tokens=True).items():
        out[id] = len(name)
    for id, token in tokenizer.get_added_tokens_decoder().items():
        out[id] = len(token.content.encode())
    return out


def vocabulary_size(path: str) -> int:
    return _tokenizer(path).get_vocab_size(with_added_tokens=True)


def _cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces begin: at each ASCII space after a byte that can't end a white-space character, and at each document's begin."""
    space = np.zeros(256, bool)
    space[list(SPACES)] = space[[0x1C, 0x1D, 0x1E, 0x1F]] = True
    s = space[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = s[1:] & ~s[:-1]
    at = np.flatnonzero(cut)
    # U+0085, U+00A0, U+1680, U+2000-U+203F, U+2040-U+207F, U+3000-U+303F: a cut that might lie inside a run of white space isn't made
    one, two, three = data[at - 1], data[at - 2], data[np.maximum(at - 3, 0)]
    odd = (one >= 0x80) & ((two == 0xC2) | ((three == 0xE1) & (two == 0x9A)) | ((three == 0xE2) & ((two == 0x80) | (two == 0x81))) | ((three == 0xE3) & (two == 0x80)))
    cut[at[odd]] = False
    cut[offsets] = True
    return np.flatnonzero(cut)


class Encoder:
    """Encodes pieces of a string column; keeps the ids of at most `most` distinct pieces."""

    def __init__(self, path: str, most: int = 400_000):
        self.tokenizer, self.most, self.bytes_of = _tokenizer(path), most, _token_bytes(path)
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.flat, self.ends = array.array("I"), array.array("q", [0])

    def _slots(self, pieces: pa.Array) -> np.ndarray:
        keys = pieces.to_pylist()
        slots = self.slots
        new = [k for k in keys if k not in slots]
        if len(slots) + len(new) > self.most:
            self._forget()
            slots, new = self.slots, keys
        # pieces between which no token can lie (one ends with a non-space, the next begins with a space) are encoded many at a time
        plain, alone = [], []
        for k in new:
            (plain if k[0] in _ASCII_SPACE and not k[-1].isspace() else alone).append(k)
        for group, each in ((plain, 256), (alone, 1)):
            runs = [group[at : at + each] for at in range(0, len(group), each)]
            for run, e in zip(runs, self.tokenizer.encode_batch_fast(["".join(r) for r in runs], add_special_tokens=False), strict=True):
                ids, before = np.array(e.ids, np.uint32), len(self.flat)
                self.flat.frombytes(ids.tobytes())
                if each > 1:
                    sizes = np.cumsum(np.fromiter(map(len, map(str.encode, run)), np.int64, len(run)))
                    ends = np.searchsorted(np.cumsum(self.bytes_of[ids]), sizes) + 1 + before
                    slots.update(zip(run, range(len(slots), len(slots) + len(run)), strict=True))
                    self.ends.frombytes(ends.astype(np.int64).tobytes())
                else:
                    slots[run[0]] = len(slots)
                    self.ends.append(len(self.flat))
        return np.fromiter(map(slots.__getitem__, keys), np.int64, len(keys))

    def encode(self, data: np.ndarray, offsets: np.ndarray, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents of a piece, one after another, and the number of each document's ids (with the end id)."""
        cuts = _cuts(data, offsets)
        pieces = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())).dictionary_encode()
        slots = self._slots(pieces.dictionary)[np.asarray(pieces.indices)]
        flat, ends = np.array(self.flat, np.uint32), np.array(self.ends, np.int64)
        first, size = ends[slots], ends[slots + 1] - ends[slots]
        before = np.concatenate(([0], np.cumsum(size)))
        ids = flat[np.repeat(first - before[:-1], size) + np.arange(before[-1])]
        starts = before[np.searchsorted(cuts, offsets)]
        lengths = np.diff(starts)
        if end is not None:
            ids = np.insert(ids, starts[1:], end)
            lengths = lengths + 1
        return ids, lengths


def encode_texts(column: pa.Array | pa.ChunkedArray, encoder: Encoder, end: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for _, data, offsets in texts(column, 2 << 20):
        yield encoder.encode(data, offsets, end)


# --- Spark ---------------------------------------------------------------------


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def write_token_files(documents: DataFrame, tokenizer: str, *, id: str = "doc_id", text: str = "text", end: int | None = 0, block: int = BLOCK, bytes_each: int = 32 << 20, folder: str | None = None) -> DataFrame:
    """Writes the files and returns a stored table of them: part (files are in order), path, documents, ids. id is a long.

    tokenizer is the path of the tokenizer's file, which every executor has; folder is a URI that all of them share.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    bits = bits_for(vocabulary_size(tokenizer))
    folder = folder or new_path(spark, "tokens")
    rows = documents.select(F.col(id).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("tie"), F.col(text).alias("text"))
    ranges = rows.repartitionByRange(partitions_for(rows, bytes_each), F.col("id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("id").asc_nulls_first(), "tie", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        doc_ids, lengths, ids = [], [], []
        encoder = Encoder(tokenizer)  # its cache ends with the task
        for batch in batches:
            doc_ids += batch.column(0).to_pylist()
            for got, n in encode_texts(batch.column(2), encoder, end):
                ids.append(got.astype(np.uint16) if bits <= 16 else got)
                lengths.append(n)
        if not doc_ids:
            return
        del encoder
        part = TaskContext.get().partitionId()
        system, top = _open(folder)
        system.create_dir(top, recursive=True)
        # a name of its own for each attempt: a move never meets an existing file, and the rows returned tell which attempt counts
        attempt = uuid.uuid4().hex
        name = f"part-{part:06d}-{attempt}.tokens"
        flat = np.concatenate(ids)
        with system.open_output_stream(temporary := f"{top}/.{attempt}") as out:
            out.write(encode_file(doc_ids, np.concatenate(lengths), flat, bits, block))
        system.move(temporary, f"{top}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([f"{folder}/{name}"]), pa.array([len(doc_ids)]), pa.array([len(flat)])], names=["part", "path", "documents", "ids"])

    return stored(ranges.mapInArrow(freed(write), "part long, path string, documents long, ids long"), "token-files")


def read_token_files(files: DataFrame) -> DataFrame:
    """One row for each document, read back from the files: id, start (ids in all documents before it), n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), path, position (in its file)."""
    # one row a file: the window holds file names and counts, not documents
    placed = files.withColumn("start", F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    many = max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, name = _open(path)
                with system.open_input_file(name) as file:
                    tokens = TokenFile(file)
                    at = 0
                    while at < len(tokens):  # some documents at a time
                        to = max(at + 1, int(np.searchsorted(tokens.starts, tokens.starts[at] + (1 << 20), "right")) - 1)
                        ids = tokens.slice(int(tokens.starts[at]), int(tokens.starts[to])).astype("<u4")
                        own = tokens.starts[at : to + 1] - tokens.starts[at]
                        crc = [zlib.crc32(ids[a:b]) for a, b in zip(own[:-1].tolist(), own[1:].tolist(), strict=True)]
                        doc = tokens.doc_ids[at:to]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(doc, mask=doc == NULL_ID), pa.array(tokens.starts[at:to] + start), pa.array(np.diff(own)), pa.array(crc, pa.int64()), pa.array([path] * (to - at)), pa.array(np.arange(at, to))],
                            names=["id", "start", "n_tokens", "ids_crc32", "path", "position"],
                        )
                        at = to

    return placed.select("path", "start").repartition(many, "path").mapInArrow(freed(read), "id long, start long, n_tokens long, ids_crc32 long, path string, position long")
