"""Words of many texts at once, as numpy arrays over the bytes of an Arrow column.

Every function works on one block of documents: their UTF-8 bytes one after the other. Words, hashes and
word n-grams come out as flat arrays in document order.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from driftwatch.session import ship_package

BLOCK_BYTES = 1 << 20
_U = np.uint64
_SPREAD, _MIX1, _MIX2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit over all output bits."""
    x = (x ^ (x >> _U(30))) * _MIX1
    x = (x ^ (x >> _U(27))) * _MIX2
    return x ^ (x >> _U(31))


@functools.cache
def _byte_values() -> np.ndarray:
    return mix((np.arange(256, dtype=_U) + _U(1)) * _SPREAD)


@functools.cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base, and of its inverse, modulo 2^64."""
    base = _U(0xD6E8FEB86659FD93)
    inverse = _U(pow(int(base), -1, 1 << 64))
    up, down = np.full(size, base), np.full(size, inverse)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``size`` powers; sizes are rounded up so that few tables are made."""
    return _powers(BLOCK_BYTES + 1) if size <= BLOCK_BYTES + 1 else _powers.__wrapped__(size)


@dataclass
class Block:
    """``data``: bytes with A-Z lowered; ``offsets``: where each document starts, and the end; ``first``: its row."""

    raw: np.ndarray
    data: np.ndarray
    offsets: np.ndarray
    first: int

    def __len__(self) -> int:
        return len(self.offsets) - 1


def blocks(column: pa.Array | pa.ChunkedArray, size: int = BLOCK_BYTES, rows: int = 1 << 40) -> Iterator[Block]:
    """The texts of a string column in blocks of about ``size`` bytes and at most ``rows`` rows; null is the empty text.

    A document is never cut: a longer one is a block by itself.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        last = min(last, first + rows)
        raw = data[offsets[first]:offsets[last]]
        lowered = raw.copy()
        lowered[(raw >= 65) & (raw <= 90)] += 32
        yield Block(raw, lowered, offsets[first:last + 1] - offsets[first], first)
        first = last


@functools.cache
def word_bytes(kind: str) -> np.ndarray:
    """Which lowered bytes belong to words: ``space``, all but ASCII white space; ``plain``, digits, a-z, non-ASCII;
    ``token``, digits, a-z and + / _ = -."""
    b = np.arange(256)
    if kind == "space":
        return ~((b == 32) | ((b >= 9) & (b <= 13)))
    if kind == "token":
        return ((b >= 48) & (b <= 57)) | ((b >= 97) & (b <= 122)) | np.isin(b, list(b"+/_=-"))
    return ((b >= 48) & (b <= 57)) | ((b >= 97) & (b <= 122)) | (b >= 128)


@dataclass
class Words:
    """``start``, ``end``: byte places; ``doc``: document in the block; ``counts``: words per document."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    counts: np.ndarray

    @property
    def begins(self) -> np.ndarray:
        """Where each document's words begin, and their number."""
        return np.concatenate([[0], np.cumsum(self.counts)])


def words(block: Block, kind: str = "space") -> Words:
    inside = word_bytes(kind)[block.data]
    before = np.concatenate([[False], inside[:-1]]) if len(inside) else inside
    starts = inside & ~before
    edges = block.offsets[1:-1]
    edges = edges[edges < len(inside)]
    starts[edges] = inside[edges]
    after = np.concatenate([~inside[1:] | starts[1:], [True]]) if len(inside) else inside
    start = np.flatnonzero(starts)
    end = np.flatnonzero(inside & after) + 1
    begins = np.searchsorted(start, block.offsets)
    counts = np.diff(begins)
    return Words(start, end, np.repeat(np.arange(len(block)), counts), counts)


def code_points(block: Block) -> np.ndarray:
    """For each byte of the block, and its end: how many code points lie before it."""
    return np.concatenate([[0], np.cumsum((block.raw & 0xC0) != 0x80)])


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(_byte_values()[data] * up[:len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(_U) * _SPREAD)


_LEFT = np.array([(1 << (8 * i)) - 1 for i in range(9)], _U)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; every eight bytes pass a non-linear mix that knows their place.

    Unlike the running sums of ``span_hashes`` it tells apart words that a polynomial modulo 2^64 confuses.
    """
    size = end - start
    parts = (size + 7) >> 3
    first = np.cumsum(parts) - parts
    part = np.arange(int(parts.sum())) - np.repeat(first, parts)
    at = np.repeat(start, parts) + 8 * part
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(data) + 1, np.dtype("<u8"), padded, strides=(1,))
    values = eights[at] & _LEFT[np.minimum(np.repeat(end, parts) - at, 8)]
    mixed = mix(values + (part + 1).astype(_U) * _SPREAD)
    sums = np.zeros(len(size), _U)
    some = parts > 0
    if some.any():
        sums[some] = np.add.reduceat(mixed, first[some])
    return mix(sums + size.astype(_U) * _MIX1)


def ngrams(hashes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words inside a document, and each one's document.

    A document of fewer words, but not none, gives one: all its words.
    """
    doc = np.repeat(np.arange(len(counts)), counts)
    begins = np.concatenate([[0], np.cumsum(counts)])
    total = len(hashes)
    out = np.zeros(total, _U)
    for i in range(n):
        part = hashes[i:] if i else hashes
        left = begins[1:][doc[:len(part)]] - np.arange(len(part)) > i
        turn = _U((i + 1) * int(_SPREAD) % (1 << 64))
        out[:len(part)] += np.where(left, mix(part + turn), _U(0)) * _U(2 * i + 1)
    place = np.arange(total) - begins[doc]
    keep = place <= np.maximum(counts[doc] - n, 0)
    return mix(out[keep]), doc[keep]


def distinct(doc: np.ndarray, values: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """``values`` sorted and distinct within each document, and how many each has. ``doc`` ascends."""
    if not len(values):
        return values, np.zeros(docs, np.int64)
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    new = np.concatenate([[True], (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])])
    return values[new], np.bincount(doc[new], minlength=docs)


def trimmed(run: Callable) -> Callable:
    """``run`` over Arrow batches, with free memory handed back to the system when a task ends.

    Worker processes live on from task to task and would otherwise hold the most that any task has needed.
    """
    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):      # other C libraries have no such call
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def per_document(docs: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(texts, doc_ids) -> columns`` over Arrow batches of doc_id and text; ``schema`` names the columns.

    ``texts`` is an Arrow string array. Work is by batch, so memory does not grow with a partition.
    """
    ship_package(docs.sparkSession)
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [x if isinstance(x, pa.Array) else pa.array(x) for x in
                     fn(batch.column("text"), batch.column("doc_id"))], names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
