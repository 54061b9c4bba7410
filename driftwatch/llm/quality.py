"""Quality classifier: n-gram indicators scaled by class log-count ratios, and a linear hinge loss on top."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwatch.llm import flat
from driftwatch.llm.common import held_out
from driftwatch.session import ship_package

HALF = 1 << 14
FEATURES = 2 * HALF  # hashed byte trigrams, then hashed runs of one to three word shapes
ROWS = 256           # documents whose indicators are held as one matrix
CUT = 0.7            # fixed value: score from which a document counts as good


def _shapes(block: flat.Block, w: flat.Words) -> np.ndarray:
    """Per word: length class, letter case, last byte unless it is a letter, and whether it repeats the word before."""
    total = lambda m: np.concatenate([[0], np.cumsum(m)])
    capitals = total((block.raw >= 65) & (block.raw <= 90))
    letters = total(((block.data >= 97) & (block.data <= 122)) | (block.data >= 128))
    length = np.searchsorted([2, 4, 8, 16], w.end - w.start, "right")
    n_capitals, n_letters = capitals[w.end] - capitals[w.start], letters[w.end] - letters[w.start]
    case = (n_letters > 0) * 1 + (n_capitals > 0) * 1 + (n_capitals > 1) * 1
    last = block.data[w.end - 1]
    mark = np.where((last >= 97) | ((last >= 48) & (last <= 57)), 0, last)
    code = flat.span_hashes(block.data, w.start, w.end)
    same = np.zeros(len(code), np.int64)
    same[1:] = (code[1:] == code[:-1]) & (w.doc[1:] == w.doc[:-1])
    return ((length * 4 + case) * 2 + same) * 128 + mark


def indicators(block: flat.Block) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of every distinct feature of every document, in order of documents. Give ``ROWS`` at most."""
    seen = np.zeros((len(block), FEATURES), bool)
    raw = block.raw.astype(np.uint32)
    size = np.diff(block.offsets)
    doc = np.repeat(np.arange(len(block)), size)
    if len(raw) > 2:
        inside = doc[2:] == doc[:-2]
        gram = ((raw[:-2] << np.uint32(16) | raw[1:-1] << np.uint32(8) | raw[2:]) * np.uint32(2654435761)) >> np.uint32(18)
        seen[doc[:-2][inside], gram[inside]] = True
    w = flat.words(block)
    shape = flat.mix(_shapes(block, w).astype(np.uint64))
    for n in (1, 2, 3):
        gram, owner = flat.ngrams(shape, w.counts, n)
        seen[owner, HALF + (gram >> np.uint64(50)).astype(np.int64)] = True
    return np.nonzero(seen)


def _sample(docs: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    """Label and features of at most ``size`` labelled documents that are not held out, those of least hash."""
    picked = (labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", 4))
              .groupBy("doc_id").agg((F.avg("quality") >= 0.5).alias("good"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(size))
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")

    def features(batches):
        for batch in batches:
            found = []
            for block in flat.blocks(batch.column("text"), rows=ROWS):
                doc, feature = indicators(block)
                found += [x.astype(np.uint16).tobytes() for x in np.split(feature, np.searchsorted(doc, range(1, len(block))))]
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("good"), pa.array(found, pa.binary())],
                                                 ["doc_id", "good", "features"])

    return (rows.select("doc_id", "good", "text").mapInArrow(features, "doc_id long, good boolean, features binary")
            .groupBy("doc_id").agg(F.min(F.struct("good", "features")).alias("r")).select("r.*"))


def fit(examples: list[tuple[bool, np.ndarray]], cost: float = 1.0, rounds: int = 10) -> tuple[np.ndarray, np.ndarray, float, float]:
    """(ratios, weights, slope, shift) from (label, features): a document's score is
    1 / (1 + exp(-(slope * margin + shift))).

    The ratio of a feature is the log of its smoothed share of good documents over that of bad ones. Weights
    minimise the hinge loss over documents of unit length by dual coordinate descent; both classes weigh the
    same. Every fifth example is left out of that and fits the slope and shift.
    """
    good = np.array([g for g, _ in examples], bool)
    if len(set(good.tolist())) < 2:
        share = float(good.mean()) if len(good) else 0.5
        return np.zeros(FEATURES, np.float32), np.zeros(FEATURES + 1, np.float32), 0.0, 4.0 * (share - 0.5)
    counts = np.ones((2, FEATURES))
    for g, f in examples:
        counts[int(g), f] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    own = [(f, ratio[f] / max(np.linalg.norm(ratio[f]), 1e-9)) for _, f in examples]
    y = np.where(good, 1.0, -1.0)
    most = np.where(good, cost * len(y) / (2 * good.sum()), cost * len(y) / (2 * (~good).sum()))
    train = np.flatnonzero(np.arange(len(y)) % 5 != 4)
    weight, alpha, rng = np.zeros(FEATURES + 1), np.zeros(len(y)), np.random.default_rng(0)
    for _ in range(rounds):
        for i in rng.permutation(train).tolist():
            f, v = own[i]
            gradient = y[i] * (weight[f] @ v + weight[-1]) - 1
            new = min(max(alpha[i] - gradient / 2.0, 0.0), most[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                weight[f] += step * v
                weight[-1] += step
                alpha[i] = new
    margin = np.array([weight[f] @ v + weight[-1] for f, v in own])
    rest = np.setdiff1d(np.arange(len(y)), train)
    rest = rest if len(set(good[rest].tolist())) == 2 else np.arange(len(y))
    slope, shift = _calibrated(margin[rest], good[rest])
    return ratio.astype(np.float32), weight.astype(np.float32), slope, shift


def _calibrated(margin: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Logistic fit by Newton steps with smoothed targets, each class weighing half."""
    n1, n0 = good.sum(), (~good).sum()
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    share = np.where(good, 0.5 / n1, 0.5 / n0)
    beta, x = np.array([1.0, 0.0]), np.stack([margin, np.ones(len(margin))], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ beta)))
        gradient = x.T @ (share * (p - target)) + 1e-3 * beta
        beta -= np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), gradient)
    return float(beta[0]), float(beta[1])


def model(docs: DataFrame, labels: DataFrame, size: int = 8192):
    """The fitted classifier; a task of at most ``size`` rows fits it."""
    def run(batches):
        rows = [r for batch in batches for r in batch.to_pylist()]
        parts = fit([(r["good"], np.frombuffer(r["features"], np.uint16).astype(int))
                     for r in sorted(rows, key=lambda r: (zlib.crc32(r["features"]), r["good"]))])
        yield pa.RecordBatch.from_arrays([pa.array([parts[0].tobytes()]), pa.array([parts[1].tobytes()]),
                                          pa.array([parts[2]]), pa.array([parts[3]])], ["ratio", "weight", "slope", "shift"])

    ship_package(docs.sparkSession)
    row = _sample(docs, labels, size).repartition(1).mapInArrow(
        run, "ratio binary, weight binary, slope double, shift double").collect()
    if not row:
        return fit([])
    return np.frombuffer(row[0].ratio, np.float32), np.frombuffer(row[0].weight, np.float32), row[0].slope, row[0].shift


def scorer(fitted):
    """A function from an Arrow column of texts to their scores."""
    ratio, weight, slope, shift = fitted

    def scores(texts) -> np.ndarray:
        out = [np.zeros(0)]
        for block in flat.blocks(texts, rows=ROWS):
            doc, feature = indicators(block)
            r = ratio[feature].astype(np.float64)
            dot = np.bincount(doc, r * weight[feature], len(block))
            norm = np.sqrt(np.bincount(doc, r * r, len(block)))
            out.append(1 / (1 + np.exp(-(slope * (dot / np.maximum(norm, 1e-9) + weight[-1]) + shift))))
        return np.concatenate(out)

    return scores


def quality(docs: DataFrame, labels: DataFrame, size: int = 8192) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 from a score of ``CUT``).

    Learnt from at most ``size`` labelled documents (those of least id hash) whose crc32(doc_id) mod 4 is not 2;
    whole texts of all documents are scored. Nothing but the text enters a score.

    A null text counts as empty; an empty text has the score of a document without features. Null ids are not
    learnt from. Repeated rows score alike; several labels of one id are averaged. With labels of one class or
    none, all scores are one number. Further columns are not read; an empty table gives no rows.
    """
    fitted = docs.sparkSession.sparkContext.broadcast(model(docs, labels, size))

    def scan(texts, ids):
        return [ids, pa.array(scorer(fitted.value)(texts))]

    return flat.per_document(docs, scan, "doc_id long, score double").select(
        "doc_id", held_out("doc_id", 4).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, size: int = 8192) -> DataFrame:
    """``docs``, all columns, without the rows that score below ``CUT``."""
    fitted = docs.sparkSession.sparkContext.broadcast(model(docs, labels, size))

    def keep(batches):
        for batch in batches:
            passed = pa.array(scorer(fitted.value)(batch.column(batch.schema.get_field_index("text"))) >= CUT)
            yield batch.filter(passed)

    return docs.mapInArrow(flat.trimmed(keep), docs.schema)
