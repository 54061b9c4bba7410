"""Packing into as few sequences as possible: a configuration program over the length histogram."""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwatch.llm import flat
from driftwatch.llm.common import stored
from driftwatch.llm.packing import Encoder
from driftwatch.session import ship_package

WINDOW = 1024
END = 2            # fixed value: id after each document
ROUNDS = 60        # pricing rounds of the program
STEP = 0.1         # share of its count that a length may gain in a round

# First bytes of characters beyond ASCII that may be white space (U+0085, U+00A0, U+1680, U+2000 to
# U+205F, U+3000 begin with these).
_MAYBE_SPACE = np.isin(np.arange(256), (0xC2, 0xE1, 0xE2, 0xE3))


class ByteEncoder(Encoder):
    """Token ids under a byte-level vocabulary, each distinct chunk encoded once.

    A chunk starts where one plain space stands between two characters that are not white space. Splitting rules
    of the vocabulary take such a space with what follows and look at nothing before it, so a text's ids are its
    chunks' ids one after the other. A full stop or comma that ends a chunk after an ASCII letter or digit is a
    chunk by itself for the same reason.
    """

    cuts: np.ndarray
    inner: np.ndarray

    def _words(self, block: flat.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data = block.data = block.raw
        n = len(data)
        at = np.flatnonzero(data == 32)
        at = at[(at > 0) & (at < n - 1)]
        before, after = data[at - 1], data[np.minimum(at + 1, n - 1)]
        plain = ((before > 32) & (before < 127)) | (before >= 128)
        for back in (2, 3):                                # the character before must surely be no white space
            lead = data[np.maximum(at - back, 0)]
            plain &= ~((before >= 128) & (before < 192) & _MAYBE_SPACE[lead] & (at >= back))
        plain &= ((after > 32) & (after < 127)) | ((after >= 128) & ~_MAYBE_SPACE[after])
        bounds = np.zeros(n + 1, bool)
        bounds[block.offsets] = True
        self.cuts = np.zeros(n + 1, bool)
        self.cuts[at[plain & ~bounds[at] & ~bounds[at + 1]]] = True
        begins = self.cuts.copy()
        begins[block.offsets[:-1][np.diff(block.offsets) > 0]] = True
        start = np.flatnonzero(begins)
        end = np.append(start[1:], n)[:len(start)]
        last, second = data[end - 1], data[np.maximum(end - 2, 0)]
        word = ((second >= 97) & (second <= 122)) | ((second >= 65) & (second <= 90)) | ((second >= 48) & (second <= 57))
        cut = np.flatnonzero((end - start > 1) & ((last == 44) | (last == 46)) & word)
        tails = end[cut] - 1
        ends = end.copy()
        ends[cut] = tails
        self.inner = np.zeros(n + 1, bool)                  # chunks between two cuts
        self.inner[start[self.cuts[start] & self.cuts[end]]] = True
        start = np.concatenate([start, tails])
        order = np.argsort(start, kind="stable")
        start, end = start[order], np.concatenate([ends, end[cut]])[order]
        return start, end, np.searchsorted(block.offsets, start, "right") - 1

    def _new_ids(self, block: flat.Block, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chunks between two cuts may stand in any order in one text, which is encoded in one go."""
        inner = self.inner[start]
        alone, length = super()._new_ids(block, start[~inner], end[~inner])
        size = (end - start)[inner]
        first = np.cumsum(size) - size
        joined = block.data[np.arange(int(size.sum())) + np.repeat(start[inner] - first, size)]
        one = self.tokenizer.encode(joined.tobytes().decode(), add_special_tokens=False)
        places = np.cumsum((joined & 0xC0) != 0x80)         # characters up to each byte
        of = np.searchsorted(places[first] - 1, np.fromiter((a for a, _ in one.offsets), np.int64, len(one)), "right") - 1
        counts = np.zeros(len(start), np.int64)
        counts[~inner] = length
        counts[inner] = np.bincount(of, minlength=len(first))
        out = np.zeros(counts.sum(), np.uint32)
        mine = np.repeat(inner, counts)
        out[mine], out[~mine] = np.array(one.ids, np.uint32), alone
        return out, counts


@functools.cache
def encoder(path: str) -> ByteEncoder:
    """One per worker process, so that the store of encoded chunks outlives a task."""
    return ByteEncoder(path, keep=800_000, end=END)


def pieces_of(total: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole windows, before them what is left over."""
    first = total % window
    return [(0, first)] * (first > 0) + [(s, window) for s in range(first, total, window)]


# ---- the program ---------------------------------------------------------

def dearest(prices: np.ndarray, lengths: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    """For each length the dearest filling of a window that holds it, dearest first: how often it takes each length.

    A knapsack by dynamic programming over the size; the filling that must hold a given length is that length and the
    best filling of the rest, so one table gives all of them, the dearest of all among them.
    """
    best = np.zeros(window + 1)
    choice, useful = np.full(window + 1, -1), np.zeros(window + 1, np.int64)
    for size in range(int(lengths[0]), window + 1):
        fit = int(np.searchsorted(lengths, size, "right"))
        value = prices[:fit] + best[size - lengths[:fit]]
        i = int(value.argmax())
        if value[i] > best[size - 1]:
            best[size], choice[size], useful[size] = value[i], i, size
        else:
            best[size], useful[size] = best[size - 1], useful[size - 1]
    forced = np.argsort(-prices - best[window - lengths], kind="stable")
    out = np.zeros((len(forced), len(lengths)), np.int32)
    row = np.arange(len(forced))
    out[row, forced] = 1
    size = useful[window - lengths[forced]]
    while len(row := np.flatnonzero(size)):
        i = choice[size[row]]
        out[row, i] += 1
        size[row] = useful[size[row] - lengths[i]]
    return np.minimum(out, counts).astype(np.int32)


def fractions(lengths: np.ndarray, counts: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS,
              step: float = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Fillings (a row each) and how many windows of each cover all pieces, as fractions, by multiplicative weights.

    A length that is covered less than others grows dear. Each round prices the lengths and lays the dearest
    filling of every length, dearest first, each until one of its lengths has got ``step`` of its count in this round; the weights
    fall by the shares that were gained. Amounts are scaled in the end by the least coverage (or, where some
    length has none yet, by the mean over tokens).
    """
    weight, covered = np.ones(len(lengths)), np.zeros(len(lengths))
    found: dict[bytes, float] = {}
    for _ in range(rounds):
        gained = np.zeros(len(lengths))
        for filling in dearest(weight / counts, lengths, counts, window):
            held = np.flatnonzero(filling)
            share = filling[held] / counts[held]
            amount = ((step - gained[held]) / share).min()
            if amount > 0:
                gained[held] += amount * share
                key = filling.tobytes()
                found[key] = found.get(key, 0.0) + amount
        covered += gained
        weight *= np.exp(-gained)
        weight /= weight.max()
    fillings = np.array([np.frombuffer(k, np.int32) for k in found])
    scale = covered.min() or np.average(covered, weights=counts * lengths)
    return fillings, np.array(list(found.values())) / float(scale)


def plan(lengths: np.ndarray, counts: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(fillings, windows): how many windows get each filling, so that exactly ``counts`` pieces have a place.

    ``lengths`` ascend, ``counts`` are positive. Fractions are rounded by their running sum, fullest fillings first
    and never beyond what is left; what is left then is filled from the largest length down, a filling as often as
    the counts allow. The second part does better with a mixed rest, so rounding is tried with all of the program's
    windows and with somewhat fewer, and without the fillings that leave room; the fewest windows win. All is
    bounded by the number of lengths, not of pieces.
    """
    if not len(lengths):
        return np.zeros((0, 0), np.int64), np.zeros(0, np.int64)
    found, amounts = fractions(lengths, counts, window, rounds)
    order = np.lexsort((-amounts, -(found @ lengths)))
    tries = [_rounded(lengths, counts, found[order], amounts[order] * part, window, room)
             for part in (1.0, 0.98, 0.9) for room in (0, window // 64, window)]
    return min(tries, key=lambda x: x[1].sum())


def _rounded(lengths: np.ndarray, counts: np.ndarray, found: np.ndarray, amounts: np.ndarray, window: int,
             room: int) -> tuple[np.ndarray, np.ndarray]:
    """``plan`` from the fillings with at most ``room`` to spare."""
    left, fillings, windows = counts.astype(np.int64), [], []

    def lay(filling: np.ndarray, most: int) -> None:
        held = np.flatnonzero(filling)
        many = min(most, int((left[held] // filling[held]).min()))
        if many > 0:
            left[held] -= many * filling[held]
            fillings.append(filling.astype(np.int64))
            windows.append(many)

    use = found @ lengths >= window - room
    whole = np.floor(np.cumsum(amounts[use]) + 0.5).astype(np.int64)
    for filling, most in zip(found[use], np.diff(whole, prepend=0).tolist(), strict=True):
        if most:
            lay(filling, most)
    while left.any():
        filling, gap = np.zeros(len(lengths), np.int64), window
        for i in np.flatnonzero(left)[::-1]:
            many = min(gap // int(lengths[i]), int(left[i]))
            if many:
                filling[i], gap = many, gap - many * int(lengths[i])
                if not gap:
                    break
        lay(filling, 1 << 62)
    return np.array(fillings, np.int64), np.array(windows, np.int64)


class Slots:
    """Places by length and rank: piece number r of a length belongs at (sequence, offset)."""

    def __init__(self, lengths: np.ndarray, fillings: np.ndarray, windows: np.ndarray):
        first = np.cumsum(windows) - windows
        offsets = np.cumsum(fillings * lengths, 1) - fillings * lengths
        self.table: dict[int, tuple] = {}
        for i, n in enumerate(lengths.tolist()):
            use = np.flatnonzero(fillings[:, i])
            many = fillings[use, i]
            self.table[n] = (np.cumsum(windows[use] * many), many, first[use], offsets[use, i])
        self.sequences = int(windows.sum())

    def place(self, length: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends, many, first, offset = self.table[length]
        p = np.searchsorted(ends, rank, "right")
        inside = rank - np.where(p > 0, ends[p - 1], 0)
        return first[p] + inside // many[p], offset[p] + inside % many[p] * length


# ---- the operator --------------------------------------------------------

def tokenised(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Pieces with ``task`` and ``rank``, a piece's number among those of its task and length."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "doc_tokens", "task", "rank"] + ["ids"] * with_ids

    def run(batches):
        encode, task = encoder(tokenizer_path).encode, TaskContext.get().partitionId()
        seen = np.zeros(window + 1, np.int64)
        for batch in batches:
            ids_of = batch.column("doc_id").to_pylist()
            for block in flat.blocks(batch.column("text")):
                ids, counts = encode(block)
                cols, data = [[] for _ in range(8)], []
                for i, own in enumerate(np.split(ids.astype("<u4"), np.cumsum(counts)[:-1])):
                    for k, (start, n) in enumerate(pieces_of(len(own), window)):
                        part = own[start:start + n]
                        for c, v in zip(cols, (ids_of[block.first + i], k, start, n, zlib.crc32(part.tobytes()), len(own),
                                               task, int(seen[n])), strict=True):
                            c.append(v)
                        seen[n] += 1
                        if with_ids:
                            data.append(part)
                out = [pa.array(c, pa.int32() if k == 1 else pa.int64()) for k, c in enumerate(cols)]
                if with_ids:
                    ends = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int32)
                    out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(data).astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, names)

    return docs.select("doc_id", "text").mapInArrow(flat.trimmed(run), (
        "doc_id long, piece int, start long, length long, ids_crc32 long, doc_tokens long, task long, rank long"
        + ", ids array<int>" * with_ids))


def packed(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, rounds: int = ROUNDS,
           with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, doc_tokens, and with
    ``with_ids`` the token ids.

    A document's ids, with a final id 2, stay whole up to ``window`` ids; a longer one is cut into windows, with the
    shorter piece first. Only the histogram of piece lengths (at most ``window`` rows) goes to the driver, where
    the configuration program is solved and rounded into fillings with exactly as many places as there are pieces.
    A piece finds its place by its number among all of its length: its number in its task plus those of the tasks
    before, which come from a running sum over counts by (task, length). So nothing is sorted by length, however many pieces
    have the same; the tasks' counts and numbers are those of one written table.

    Null and empty texts have the final id only. Repeated rows are packed each for itself. Further columns are
    not read; an empty table gives no rows.
    """
    ship_package(docs.sparkSession)
    pieces = stored(tokenised(docs, tokenizer_path, window, with_ids), "pieces")
    counted = stored(pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = counted.groupBy("length").agg(F.sum("n").alias("n")).orderBy("length").collect()
    lengths, counts = (np.array([r[c] for r in histogram], np.int64) for c in ("length", "n"))
    slots = Slots(lengths, *plan(lengths, counts, window, rounds))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    starts = counted.select(F.col("length").alias("_length"), F.col("task").alias("_task"), F.coalesce(before, F.lit(0)).alias("first"))
    ranked = pieces.join(starts, (F.col("task") == F.col("_task")) & (F.col("length") == F.col("_length"))).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("rank")).alias("rank"), "doc_tokens",
        *["ids"] * with_ids)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "doc_tokens"] + ["ids"] * with_ids

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            values, first = np.unique(length[order], return_index=True)
            for n, at in zip(values.tolist(), np.split(order, first[1:]), strict=True):
                sequence[at], offset[at] = slots.place(n, rank[at])
            new = {"sequence_id": pa.array(sequence), "offset": pa.array(offset)}
            yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(c) for c in names], names)

    return ranked.mapInArrow(place, (
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, doc_tokens long"
        + ", ids array<int>" * with_ids))
