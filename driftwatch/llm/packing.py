"""Packing of tokenised documents into sequences for several context sizes."""

from __future__ import annotations

import functools
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from driftwatch.llm import flat
from driftwatch.session import ship_package

END = 1  # fixed value: id after each document
TIERS = (2048, 1024, 512, 256)


class Encoder:
    """Token ids of many texts, each distinct word encoded once.

    The vocabulary drops white space and lowers letters, and no rule of it reaches over ASCII white space.
    So the ids of a text are those of its words one after the other, whatever stands around them. One final
    full stop or comma after an ASCII letter or digit is a word by itself for the same reason. Distinct words
    are kept by hash, ``keep`` of them at most; beyond, the store starts anew.
    """

    def __init__(self, path: str, keep: int = 300_000, end: int = END):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.keep, self.end = Tokenizer.from_file(path), keep, end
        self._clear()

    def _clear(self) -> None:
        self.codes = np.zeros(0, np.uint64)
        self.where, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.store = np.zeros(0, np.uint32)

    def _words(self, block: flat.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and document; words that could hold a special token keep their case."""
        w = flat.words(block)
        start, end, doc = w.start, w.end, w.doc
        for i in np.flatnonzero(block.data == 60).tolist():
            k = int(np.searchsorted(start, i, "right")) - 1
            block.data[start[k]:end[k]] = block.raw[start[k]:end[k]]
        last, before = block.data[end - 1], block.data[np.maximum(end - 2, 0)]
        plain = ((before >= 97) & (before <= 122)) | ((before >= 48) & (before <= 57))
        cut = np.flatnonzero((end - start > 1) & ((last == 44) | (last == 46)) & plain)
        tails = end[cut] - 1
        end = end.copy()
        end[cut] = tails
        order = np.argsort(np.concatenate([start, tails]), kind="stable")
        return tuple(np.concatenate(p)[order] for p in ((start, tails), (end, tails + 1), (doc, doc[cut])))

    def _new_ids(self, block: flat.Block, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the given words, one after the other, and how many each has."""
        ids = [e.ids for e in self.tokenizer.encode_batch(
            [block.data[a:b].tobytes().decode() for a, b in zip(start.tolist(), end.tolist(), strict=True)],
            add_special_tokens=False)]
        return np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids], np.int64)

    def encode(self, block: flat.Block) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the block's documents, each with its final id, and the number of each document."""
        start, end, doc = self._words(block)
        code = flat.word_hashes(block.data, start, end)
        unique, first, inverse = np.unique(code, return_index=True, return_inverse=True)
        if len(self.codes) > self.keep:
            self._clear()
        at = np.minimum(np.searchsorted(self.codes, unique), max(len(self.codes) - 1, 0))
        new = self.codes[at] != unique if len(self.codes) else np.ones(len(unique), bool)
        if new.any():
            ids, length = self._new_ids(block, start[first[new]], end[first[new]])
            where = len(self.store) + np.cumsum(length) - length
            self.store = np.concatenate([self.store, ids])
            codes = np.concatenate([self.codes, unique[new]])
            order = np.argsort(codes)
            self.codes = codes[order]
            self.where = np.concatenate([self.where, where])[order]
            self.length = np.concatenate([self.length, length])[order]
        slot = np.searchsorted(self.codes, unique)[inverse]
        length = self.length[slot]
        places = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length - self.where[slot], length)
        counts = np.bincount(doc, length, len(block)).astype(np.int64) + 1
        out = np.full(counts.sum(), self.end, np.uint32)
        body = np.ones(len(out), bool)
        body[np.cumsum(counts) - 1] = False
        out[body] = self.store[places]
        return out, counts


class Shelf:
    """Pieces by length, with the longest that fits a gap found in one step."""

    def __init__(self):
        self.by_length: dict[int, list] = {}
        self.held = 0

    def put(self, piece: tuple) -> None:
        self.by_length.setdefault(piece[2], []).append(piece)
        self.held |= 1 << piece[2]

    def _take(self, length: int) -> tuple:
        pieces = self.by_length[length]
        piece = pieces.pop()
        if not pieces:
            self.held ^= 1 << length
        return piece

    def longest(self, gap: int) -> tuple | None:
        n = (self.held & ((1 << (gap + 1)) - 1)).bit_length() - 1
        return self._take(n) if n > 0 else None

    def shortest(self) -> tuple | None:
        return self._take((self.held & -self.held).bit_length() - 1) if self.held else None


class Packer:
    """Sequences of pieces for several context sizes, from documents that come a few at a time.

    Whole windows of the largest size leave at once. What is left of a document is routed to the shelf of the
    smallest tier that holds it, and each tier is packed into windows of its own size: its longest piece opens a
    window, and the gap takes the longest piece that fits, of its own or a shorter tier; where none fits, the
    shortest piece left is cut (in the largest tier only if the gap is ``least_cut`` or more). Windows of the
    shorter tiers are exactly full and, being powers of two, need no padding.

    ``open_windows``: how many windows' worth of tokens stay on the shelves for later documents to be packed with.
    Only those documents are held; ``take(last=True)`` packs the rest and cuts the last window into powers of two.
    """

    def __init__(self, tiers: tuple[int, ...] = TIERS, least_cut: int = 16, open_windows: int = 64):
        if any(t & (t - 1) for t in tiers[1:]):
            raise ValueError("the shorter tiers must be powers of two")
        self.tiers, self.least_cut, self.open = tiers, least_cut, open_windows * tiers[0]
        self.shelves, self.held, self.out = [Shelf() for _ in tiers], 0, []

    def _route(self, n: int) -> int:
        return max(i for i, t in enumerate(self.tiers) if n <= t)

    def put(self, doc: int, total: int) -> None:
        window = self.tiers[0]
        whole = total - total % window
        self.out.extend([(doc, s, window)] for s in range(0, whole, window))
        if total > whole:
            self.held += total - whole
            self.shelves[self._route(total - whole)].put((doc, whole, total - whole))

    def take(self, last: bool = False) -> list[list[tuple[int, int, int]]]:
        """Sequences of (document, start, length) that are ready."""
        for tier, shelf in enumerate(self.shelves):
            while (last or self.held > self.open) and (piece := shelf.longest(self.tiers[tier])) is not None:
                row = self._filled(tier, piece)
                size = sum(n for *_, n in row)
                self.held -= size
                full = size == self.tiers[tier] or not tier and size > self.tiers[0] - self.least_cut
                self.out.extend([row] if full else _powers(row))
        out, self.out = self.out, []
        return out

    def _filled(self, tier: int, piece: tuple[int, int, int]) -> list[tuple[int, int, int]]:
        row, gap = [piece], self.tiers[tier] - piece[2]
        while gap:
            piece = next((p for s in self.shelves[tier:] if (p := s.longest(gap)) is not None), None)
            if piece is None:
                source = next((s for s in reversed(self.shelves) if s.held), None)
                if source is None or not tier and gap < self.least_cut:
                    break
                doc, start, n = source.shortest()
                piece = (doc, start, gap)
                rest = (doc, start + gap, n - gap)
                self.shelves[max(tier, self._route(rest[2]))].put(rest)
            row.append(piece)
            gap -= piece[2]
        return row


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS, least_cut: int = 16) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) for documents of these lengths, all packed together."""
    packer = Packer(tiers, least_cut)
    for doc, total in enumerate(lengths):
        packer.put(doc, total)
    return packer.take(last=True)


def _powers(row: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """A row cut so that each part's length is a power of two."""
    out = []
    while row:
        size = 1 << (sum(n for *_, n in row).bit_length() - 1)
        part, room = [], size
        while room:
            doc, start, n = row.pop(0)
            part.append((doc, start, min(n, room)))
            if n > room:
                row.insert(0, (doc, start + room, n - room))
            room -= min(n, room)
        out.append(part)
    return out


def step_groups(sequences: list[list[tuple[int, int, int]]], size: int) -> np.ndarray:
    """Groups of about ``size`` sequences with like attention cost (sum of squared lengths), dealt back and forth."""
    cost = np.array([sum(n * n for *_, n in row) for row in sequences])
    groups = -(-len(sequences) // size)
    turn = np.arange(len(sequences)) % (2 * max(groups, 1))
    out = np.zeros(len(sequences), np.int64)
    out[np.argsort(-cost, kind="stable")] = np.minimum(turn, 2 * groups - 1 - turn)
    return out


@functools.cache
def encoder(path: str) -> Encoder:
    """One per worker process, so that the store of encoded words outlives a task."""
    return Encoder(path)


def packed(docs: DataFrame, tokenizer_path: str, tiers: tuple[int, ...] = TIERS, step: int = 64,
           with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length,
    step_group, and with ``with_ids`` the token ids.

    A document's ids, with a final id 1, are cut into pieces that a ``Packer`` lays into sequences of the sizes in
    ``tiers``, one per task: nothing is shuffled. Texts are read in blocks of 1 MB; what is held beside one block are
    the ids of documents on the shelves (64 windows) and of sequences waiting for their step group (fewer than
    ``step``). A sequence is full to within 15 ids, or its length is a power of two. A step group has ``step``
    sequences of one task with like attention cost dealt over its neighbours; a task's last may have fewer.

    Null and empty texts have the final id only. Repeated rows are packed each for itself. Further columns are
    not read; an empty table gives no rows.
    """
    ship_package(docs.sparkSession)
    ready = 8 * step

    def run(batches):
        encode, task, serial, group, number = encoder(tokenizer_path).encode, TaskContext.get().partitionId(), 0, 0, 0
        packer, texts, waiting = Packer(tiers), {}, []

        def give(rows):
            nonlocal serial, group
            groups = step_groups(rows, step)
            cols: list[list] = [[] for _ in range(9)]
            data = []
            for s, row in enumerate(rows):
                offset, size = 0, sum(n for *_, n in row)
                for doc, start, n in row:
                    entry = texts[doc]
                    own = entry[1][start:start + n]
                    for c, v in zip(cols, (entry[0], start, n, zlib.crc32(own.astype("<u4").tobytes()), len(entry[1]),
                                           (task << 32) + serial + s, offset, size, (task << 32) + group + int(groups[s])),
                                    strict=True):
                        c.append(v)
                    data.append(own)
                    offset += n
                    entry[2] -= n
                    if not entry[2]:
                        del texts[doc]
            serial, group = serial + len(rows), group + int(groups.max(initial=-1)) + 1
            out = [pa.array(c, pa.int64()) for c in cols]
            if with_ids:
                ends = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int32)
                out.append(pa.ListArray.from_arrays(ends, np.concatenate(data).astype(np.int32)))
            return pa.RecordBatch.from_arrays(out, names)

        for batch in batches:
            ids_of = batch.column("doc_id").to_pylist()
            for block in flat.blocks(batch.column("text")):
                ids, counts = encode(block)
                for i, own in enumerate(np.split(ids, np.cumsum(counts)[:-1])):
                    texts[number] = [ids_of[block.first + i], own.copy(), len(own)]
                    packer.put(number, len(own))
                    number += 1
                waiting += packer.take()
                if (whole := len(waiting) // ready * ready):
                    yield give(waiting[:whole])
                    waiting = waiting[whole:]
        waiting += packer.take(last=True)
        if waiting:
            yield give(waiting)

    schema = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
              "sequence_length long, step_group long") + ", ids array<int>" * with_ids
    names = [part.split()[0] for part in schema.split(", ")]
    return docs.select("doc_id", "text").mapInArrow(flat.trimmed(run), schema)
