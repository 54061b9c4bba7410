"""Language identification: each document as a mixture of languages, its parts found by expectation-maximisation."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwatch.llm import flat
from driftwatch.llm.common import held_out
from driftwatch.session import ship_package

GRAMS = 1 << 14
NONE = "und"  # fixed value: no text or no letter


def _grams(block: flat.Block) -> np.ndarray:
    """For each byte the hashed trigram around it; white space, digits and document ends count as one sign each."""
    data = block.data.copy()
    data[~flat.word_bytes("space")[data]] = 32
    data[(data >= 48) & (data <= 57)] = 48
    before, after = np.roll(data, 1), np.roll(data, -1)
    filled = block.offsets[:-1][np.diff(block.offsets) > 0]
    before[filled] = 32
    after[block.offsets[1:][np.diff(block.offsets) > 0] - 1] = 32
    code = before.astype(np.uint32) << np.uint32(16) | data.astype(np.uint32) << np.uint32(8) | after
    return ((code * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64)


def _merge(batches):
    """Rows of one language added up; counts travel as compressed numbers."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total[lang] = total.get(lang, 0) + np.frombuffer(zlib.decompress(data), np.int64)
    yield _rows(total)


def _rows(total: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()),
                                       pa.array([zlib.compress(v.tobytes(), 1) for v in total.values()], pa.binary())],
                                      ["lang", "counts"])


def gram_counts(docs: DataFrame, lang: str = "lang") -> dict[str, np.ndarray]:
    """Trigram counts of every language over all documents that are not held out and name one.

    Each task sends one vector of fixed size per language; they are added in two rounds.
    """
    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            names, index = np.unique(np.array(batch.column("lang").to_pylist(), object).astype(str), return_inverse=True)
            for block in flat.blocks(batch.column("text")):
                own = np.repeat(index[block.first:block.first + len(block)], np.diff(block.offsets))
                inside = flat.word_bytes("space")[block.data]
                both = np.bincount(own[inside] * GRAMS + _grams(block)[inside], minlength=len(names) * GRAMS)
                for name, part in zip(names.tolist(), both.reshape(len(names), GRAMS), strict=True):
                    total[name] = total.get(name, 0) + part
        yield _rows(total)

    ship_package(docs.sparkSession)
    rows = (docs.filter(F.col(lang).isNotNull() & ~held_out("doc_id", 4)).select("text", F.col(lang).alias("lang"))
            .mapInArrow(count, "lang string, counts binary"))
    rows = rows.repartition(16).mapInArrow(_merge, "lang string, counts binary")
    rows = rows.repartition(1).mapInArrow(_merge, "lang string, counts binary")
    return {r.lang: np.frombuffer(zlib.decompress(r.counts), np.int64) for r in rows.collect()}


class Mixture:
    """Word likelihoods by language, and the mixture of languages that a document's words make most likely."""

    def __init__(self, counts: dict[str, np.ndarray], rounds: int = 12, penalty: float = 3.0):
        self.langs = sorted(counts)
        table = np.stack([counts[x] for x in self.langs], 1) + 0.5 if counts else np.ones((GRAMS, 0))
        self.table = np.log(table / table.sum(0)).astype(np.float32)
        self.rounds, self.penalty = rounds, penalty

    def _em(self, likely, doc, edges, share, rounds):
        """Language shares after ``rounds`` of EM, and the log-likelihood of each document's words under them."""
        for _ in range(rounds):
            part = share[doc] * likely
            part /= np.maximum(part.sum(1, keepdims=True), 1e-30)
            share = np.add.reduceat(part, edges[:-1]) / np.diff(edges)[:, None]
        fit = np.log(np.maximum((share[doc] * likely).sum(1), 1e-30))
        return share, np.add.reduceat(fit, edges[:-1])

    def infer(self, block: flat.Block) -> np.ndarray:
        """Shares of each language in each document; languages outside the chosen set are zero.

        EM over all languages ranks them. For each k the k leading ones are fitted again; the set whose
        log-likelihood less ``penalty`` * k * log(words) is greatest is chosen.
        """
        out = np.zeros((len(block), len(self.langs)))
        w = flat.words(block)
        if not len(w.start) or not self.langs:
            return out
        sums = np.zeros((len(block.data) + 1, len(self.langs)))
        np.cumsum(self.table[_grams(block)], 0, out=sums[1:])
        score = sums[w.end] - sums[w.start]
        likely = np.exp(score - score.max(1, keepdims=True))
        held = np.flatnonzero(w.counts)
        edges = np.concatenate([[0], np.cumsum(w.counts[held])])
        doc = np.repeat(np.arange(len(held)), w.counts[held])
        n = len(self.langs)
        full, fit = self._em(likely, doc, edges, np.full((len(held), n), 1 / n), self.rounds)
        rank = np.argsort(np.argsort(-full, 1, kind="stable"), 1)
        cost = self.penalty * np.log(np.maximum(w.counts[held], 2))
        best, chosen = fit - cost * n, full
        for k in range(1, n):
            part = np.where(rank < k, np.maximum(full, 1e-6), 0.0)
            part /= part.sum(1, keepdims=True)
            part, fit = self._em(likely, doc, edges, part, 0 if k == 1 else 4)
            better = fit - cost * k >= best
            best = np.where(better, fit - cost * k, best)
            chosen = np.where(better[:, None], part, chosen)
        out[held] = chosen
        return out


def languages(docs: DataFrame, lang: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, langs.

    ``lang_pred`` is the language of the greatest share, ``score`` that share, ``langs`` the chosen set with
    shares. Learnt from all documents with a language whose crc32(doc_id) mod 4 is not 2.

    A null text, or one without a letter, is ``und`` with score 1; so is every text where no language can be
    learnt (score 0). Ties go to the language first by name. Repeated rows get a row each; further columns are
    not read; an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(Mixture(gram_counts(docs, lang)))

    def scan(texts, ids):
        mixture, pred, score, sets = model.value, [], [], []
        letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_pylist()
        size = flat.BLOCK_BYTES // max(4, len(mixture.langs))
        for block in flat.blocks(texts, size):
            shares = mixture.infer(block)
            for d, row in enumerate(shares):
                if not letters[block.first + d]:
                    pred.append(NONE), score.append(1.0), sets.append("")
                elif not row.any():
                    pred.append(NONE), score.append(0.0), sets.append("")
                else:
                    top = int(row.argmax())
                    pred.append(mixture.langs[top])
                    score.append(min(float(row[top]), 1.0))
                    sets.append(",".join(f"{mixture.langs[i]}:{row[i]:.4f}" for i in np.flatnonzero(row >= 5e-5)))
        return [ids, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.string())]

    found = flat.per_document(docs, scan, "doc_id long, lang_pred string, score double, langs string")
    return found.withColumn("held_out", held_out("doc_id", 4))
