"""Shared pieces: scratch tables in the shared folder, and exact cutting of text into chunks."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barweave.session import shared_folder

SLICE_BYTES = 8 << 20
MARKS = b",.;:!?"


def text_or_empty(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def one_space(text: Column) -> Column:
    """Each run of blanks as one space. Single spaces stay, so the regex leaves them alone."""
    return F.regexp_replace(text, r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def id_key(doc_id: str | Column) -> Column:
    """A join key of a nullable id: null is a value of its own."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(column.cast("string"), F.lit(""))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_folder(spark).rstrip('/')}/barweave-{name}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: lineage ends there."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``docs`` does not have in any case of letters."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


#: What a Python worker remembers from task to task, by operator.
WORKER_MEMORY: dict[str, dict] = {}


def remembered(operator: str) -> dict:
    return WORKER_MEMORY.setdefault(operator, {})


def forget_others(keeps: str) -> None:
    for name in [n for n in WORKER_MEMORY if n != keeps]:
        del WORKER_MEMORY[name]


def give_back() -> None:
    """Free memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps what it likes
        pass


def lean(run: Task, keeps: str = "") -> Task:
    """``run`` as a task that leaves little behind in its reused Python worker: first, what the
    worker remembers for operators other than ``keeps`` is dropped."""

    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(keeps)
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary lies on this machine; every machine has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer text makes a range of its own."""
    if len(texts) == 0:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    start = 0
    while start < len(texts):
        end = int(np.searchsorted(offsets, int(offsets[start]) + limit, side="right")) - 1
        end = min(max(end, start + 1), len(texts))
        yield start, end
        start = end


def as_strings(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """One 32-bit string array without nulls or a leading offset problem."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return array.cast(pa.string()) if array.type != pa.string() else array


def split_chunks(texts: pa.Array, marks: bytes = MARKS) -> tuple[pa.Array, np.ndarray]:
    """Cut every text before a blank that follows a visible character, and before one of
    ``marks`` that follows an ASCII letter.

    Returns the chunks in order and, per text, the number of its first chunk (one more
    entry than texts). No pre-tokenizer here matches across such a place: letters, other
    marks and blanks are matched apart, and only a blank may lead a match of another kind. So
    the tokens of a text are the tokens of its chunks. Only places after printable ASCII or
    a Latin letter are used; leaving others out changes nothing but the length of a chunk.
    """
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    low, high = int(offsets[0]), int(offsets[-1])
    if high == low:
        return pa.array([], pa.string()), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[low:high]
    rows = offsets.astype(np.int64) - low
    blank = (data == 32) | (data == 10)
    printable = (data > 32) & (data < 127)
    # The second byte of a two-byte letter U+00C0 to U+023F.
    latin = np.zeros(len(data), bool)
    latin[1:] = (data[:-1] >= 0xC3) & (data[:-1] <= 0xC8) & (data[1:] >= 0x80)
    cut = np.zeros(len(data) + 1, bool)
    letter = np.zeros(256, bool)
    letter[65:91] = letter[97:123] = True
    mark = np.zeros(256, bool)
    mark[list(marks)] = True
    cut[1:-1] = (blank[1:] & (printable[:-1] | latin[:-1])) | (mark[data[1:]] & letter[data[:-1]])
    cut[rows[:-1]] = True
    cut[-1] = False
    starts = np.flatnonzero(cut)
    bounds = np.append(starts, len(data)).astype(np.int32)
    chunks = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(data))
    return chunks, np.searchsorted(starts, rows, side="left")


def free_marks(added: list[str]) -> bytes:
    """The marks that occur in no added token: a cut must not run through one."""
    return bytes(c for c in MARKS if not any(chr(c) in token for token in added))


def one_thread_tokenizers() -> None:
    """Spark already runs a task per core; must come before the library is imported."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("RAYON_NUM_THREADS", "1")


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions ``start .. start + length`` of every entry, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)


class ChunkEncoder:
    """Token ids of whole texts from the tokenizers library, each distinct chunk encoded once.

    The memory holds about ``limit`` bytes and starts anew beyond that; this bounds memory and
    changes no result.
    """

    ENTRY = 180  # bytes of a remembered chunk beside its text and ids

    def __init__(self, path: str, limit: int = 96 << 20):
        one_thread_tokenizers()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.limit = limit
        self.marks = free_marks([t.content for t in self.tokenizer.get_added_tokens_decoder().values()])
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.held = 0
        self.ids = np.empty(1 << 16, np.int32)
        self.used = 0
        self.starts = np.empty(1 << 14, np.int64)
        self.lengths = np.empty(1 << 14, np.int64)

    @staticmethod
    def _room(array: np.ndarray, size: int) -> np.ndarray:
        if size <= len(array):
            return array
        grown = np.empty(max(size, 2 * len(array)), array.dtype)
        grown[: len(array)] = array
        return grown

    def _learn(self, fresh: list[str]) -> None:
        for begin in range(0, len(fresh), 4096):
            some = fresh[begin : begin + 4096]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            n, sizes = len(self.known), np.fromiter(map(len, found), np.int64, len(found))
            self.starts, self.lengths = self._room(self.starts, n + len(some)), self._room(self.lengths, n + len(some))
            self.ids = self._room(self.ids, self.used + int(sizes.sum()))
            self.starts[n : n + len(some)] = self.used + np.cumsum(sizes) - sizes
            self.lengths[n : n + len(some)] = sizes
            self.ids[self.used : self.used + int(sizes.sum())] = np.fromiter(
                (i for ids in found for i in ids), np.int32, int(sizes.sum())
            )
            self.used += int(sizes.sum())
            self.held += sum(map(len, some)) + 4 * int(sizes.sum()) + self.ENTRY * len(some)
            self.known.update(zip(some, range(n, n + len(some))))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts`` in order, and per text the place of its first one (plus the end)."""
        chunks, first = split_chunks(texts, self.marks)
        if len(chunks) == 0:
            return np.empty(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        coded = chunks.dictionary_encode()
        words = coded.dictionary.to_pylist()
        if self.held > self.limit:
            self._clear()
        self._learn([w for w in words if w not in self.known])
        place = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))[coded.indices.to_numpy()]
        lengths = self.lengths[place]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        return self.ids[ragged(self.starts[place], lengths)], ends[first]


def encoder(path: str) -> ChunkEncoder:
    """The one of this Python worker."""
    held = remembered("encoder")
    if path not in held:
        held[path] = ChunkEncoder(path)
    return held[path]
