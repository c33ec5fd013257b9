"""Helpers shared by the operators: words of a text, small slices of Arrow batches, row schemas."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of characters other than space and the controls 9 to 13. ``bytes.split()`` cuts the same way.
WORD_SQL = r"[^\x20\x09-\x0D]+"

#: Rows of a batch handled at a time, and the text bytes after which a slice ends early.
SLICE_ROWS = 1024
SLICE_BYTES = 1 << 19


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """True for rows that no model may learn from: crc32 of the id as text is a multiple of ``folds``.

    A row without an id has the checksum of an empty text, 0, and so is held out.
    """
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == 0


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of a text column; a null counts as an empty text."""
    return [b"" if v is None else v for v in column.cast(pa.large_binary()).to_pylist()]


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Parts of a batch of bounded size, so that long texts do not pile up in Python."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and (i - start >= SLICE_ROWS or total + n > SLICE_BYTES):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < len(lengths):
        yield batch.slice(start)


def map_texts(
    df: DataFrame,
    out: str,
    work: Callable[[], Callable[[list[bytes]], dict[str, list]]],
    keep: tuple[str, ...] = (),
    text: str = "text",
    only: tuple[Column, Callable[[np.ndarray], np.ndarray]] | None = None,
) -> DataFrame:
    """One output row per row: the columns ``keep`` and what ``work()`` makes of the texts.

    ``only`` is a column without nulls and a function that says from its values which rows to take.

    ``work`` is called once per task and returns the function for a list of texts. ``out`` is the
    schema of what it adds. Rows stay where they are; nothing is shuffled.
    """
    asked, chosen = ([], None) if only is None else ([only[0].alias("only")], only[1])
    rows = df.select(*[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)], *asked, F.col(text).alias("text"))
    kept = [T.StructField(c, rows.schema[f"keep_{i}"].dataType) for i, c in enumerate(keep)]
    schema = T.StructType(kept + T.StructType.fromDDL(out).fields)

    def run(batches):
        fn = work()
        for batch in batches:
            if chosen is not None:
                batch = batch.filter(pa.array(chosen(batch.column("only").to_numpy())))
            for part in slices(batch):
                made = fn(text_bytes(part.column("text")))
                arrays = [*part.columns[: len(keep)], *[v if isinstance(v, pa.Array) else pa.array(v) for v in made.values()]]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *made])
        # Workers outlive their tasks; what they hold is not there for the next stage.
        pa.default_memory_pool().release_unused()

    return rows.mapInArrow(run, schema)


def ends_of(parts: list) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the parts in their concatenation."""
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)))
    return np.concatenate(([0], ends[:-1])).astype(np.int64) if len(parts) else ends, ends


def segment_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of ascending segments of a flat array (rows of a matrix, if it is one). Empty segments give 0."""
    out = np.zeros((len(starts), *values.shape[1:]), dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    full = ends > starts
    if full.any():
        cuts = np.stack([starts[full], ends[full]], axis=1).ravel()
        cuts = cuts[:-1] if cuts[-1] == len(values) else cuts
        out[full] = np.add.reduceat(values, cuts, axis=0, dtype=out.dtype)[::2]
    return out


#: Bytes of words, bytes that begin a character, and A-Z mapped to a-z.
IN_WORD = np.ones(256, dtype=bool)
IN_WORD[[32, 9, 10, 11, 12, 13]] = False
BEGINS_CHAR = np.ones(256, dtype=bool)
BEGINS_CHAR[0x80:0xC0] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x2545F4914F6CDD1D)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


class Words:
    """The words of several texts in flat arrays: where they begin and end in ``data``, and whose they are."""

    def __init__(self, texts: list[bytes]):
        self.texts = len(texts)
        self.data = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
        at = np.cumsum([0, *[len(t) + 1 for t in texts]], dtype=np.int64)
        self.text_starts, self.text_ends = at[:-1], at[1:] - 1
        self.inside = np.flatnonzero(IN_WORD[self.data])
        breaks = np.flatnonzero(np.diff(self.inside) > 1) + 1
        self.offsets = np.concatenate(([0], breaks)) if len(self.inside) else breaks  # of the words in ``inside``
        self.starts = self.inside[self.offsets]
        self.sizes = np.diff(np.append(self.offsets, len(self.inside)))
        first = np.searchsorted(self.starts, at)
        self.first, self.last = first[:-1], first[1:]  # words of each text
        self.text = np.repeat(np.arange(self.texts), self.last - self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, without regard to A-Z case. It only depends on the word."""
        if not len(self.starts):
            return np.zeros(0, dtype=np.uint64)
        powers = np.cumprod(np.full(int(self.sizes.max()) + 1, _BASE, dtype=np.uint64))
        place = np.arange(len(self.inside)) - np.repeat(self.offsets, self.sizes)
        terms = (LOWER[self.data[self.inside]].astype(np.uint64) + np.uint64(1)) * powers[place]
        return mixed(np.add.reduceat(terms, self.offsets))

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.starts[i] + self.sizes[i]].tobytes()
