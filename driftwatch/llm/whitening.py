"""Whitened embeddings: the spectrum of all vectors, kept up to date row by row, and refined once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwatch.llm.common import stored
from driftwatch.llm.spectrum import Spectrum
from driftwatch.session import ship_package

SCALE, SHIFT = 1024, 100_000   # fixed values: an entry c becomes floor(SCALE * c) + SHIFT
BLOCK = 1024                   # rows that are reduced together before they update a spectrum
FAN_IN = 16                    # spectra that meet in one group
FLAT = 1e-12                   # share of the trace below which a direction has no variance


def entries(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows that take part, and their entries as whole numbers, one row each."""
    column = batch.column("embedding")
    column = column.cast(pa.list_(column.type.value_type)) if not pa.types.is_list(column.type) else column
    ends = column.offsets.to_numpy().astype(np.int64)
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)    # null becomes NaN
    good = np.isfinite(values)
    bad = np.concatenate([[0], np.cumsum(~good)])
    keep = np.asarray(column.is_valid()) & (np.diff(ends) == size) & (bad[ends[1:]] == bad[ends[:-1]])
    rows = np.flatnonzero(keep)
    at = ends[:-1][rows][:, None] + np.arange(size)
    c = values[at] if len(rows) else np.zeros((0, size))
    return rows, np.floor(SCALE * c).astype(np.int64) + SHIFT


def dimension(vectors: DataFrame, column: str = "embedding") -> int:
    """The length that most usable vectors have (of equals the larger), 0 if there is none."""
    usable = vectors.filter(F.expr(f"`{column}` IS NOT NULL AND size(`{column}`) > 0 AND forall(`{column}`, "
                                   "c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('Infinity'))"))
    found = usable.groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return found["d"] if found else 0


@dataclass
class Fit:
    """``sums``: exact sums of x per dimension over ``n`` rows; ``components``: unit columns by falling eigenvalue."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], float) + np.array([s % self.n for s in self.sums], float) / self.n

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean; whole parts are subtracted as whole numbers first."""
        return (x - np.array([s // self.n for s in self.sums])) - np.array([s % self.n / self.n for s in self.sums])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.eigenvalues)


def spectra(vectors: DataFrame, size: int, block: int = BLOCK) -> DataFrame:
    """(task, n, sums, spectrum): exact sums and the spectrum of each task's rows."""
    def run(batches):
        own, sums, waiting, held = Spectrum.empty(size), np.zeros(size, object), [], 0
        for batch in batches:
            _, x = entries(batch, size)
            sums += x.sum(0).astype(object)
            for first in range(0, len(x), block):
                waiting.append(x[first:first + block].astype(float) - SHIFT)
                held += len(waiting[-1])
                if held >= block:
                    own.add(np.concatenate(waiting))
                    waiting, held = [], 0
        own.add(np.concatenate([*waiting, np.zeros((0, size))]))
        if own.n:
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([own.n], pa.int64()),
                 pa.array([[str(s) for s in sums]], pa.list_(pa.string())), pa.array([own.to_bytes()], pa.binary())],
                ["task", "n", "sums", "spectrum"])

    return vectors.select("embedding").mapInArrow(run, "task long, n long, sums array<string>, spectrum binary")


def combined(parts: DataFrame, fan_in: int = FAN_IN) -> tuple[int, list[int], Spectrum] | None:
    """All spectra in one. ``fan_in`` at a time meet in a group, round by round, in order of their tasks; only the
    last one, whose size is that of a d x d matrix, comes to the driver."""
    def meet(table: pa.Table) -> pa.Table:
        table = table.sort_by("task")
        whole, total = None, 0
        for n, sums, data in zip(*(table.column(c).to_pylist() for c in ("n", "sums", "spectrum")), strict=True):
            part = Spectrum.from_bytes(n, data)
            total = np.array([int(s) for s in sums], object) + total
            if whole is None:
                whole = part
            else:
                whole.merge(part)
        return pa.table({"task": pa.array([table.column("task")[0].as_py() // fan_in], pa.int64()),
                         "n": pa.array([whole.n], pa.int64()), "sums": pa.array([[str(s) for s in total]], pa.list_(pa.string())),
                         "spectrum": pa.array([whole.to_bytes()], pa.binary())})

    parts = stored(parts, "spectra")
    last = parts.agg(F.max("task")).first()[0]
    if last is None:
        return None
    while True:
        parts = stored(parts.groupBy(F.floor(F.col("task") / fan_in).alias("to")).applyInArrow(meet, parts.schema), "spectra")
        last //= fan_in
        if not last:
            row = parts.first()
            return row["n"], [int(s) for s in row["sums"]], Spectrum.from_bytes(row["n"], row["spectrum"])


def _products(vectors: DataFrame, size: int, project, width: int, fan_in: int = 64, levels: int = 3) -> np.ndarray:
    """Sum over all rows of the outer product of ``project(x)`` with itself, added up in a tree of groups of ``fan_in``."""
    def run(batches):
        total = np.zeros((width, width))
        for batch in batches:
            _, x = entries(batch, size)
            for first in range(0, len(x), 4096):
                y = project(x[first:first + 4096])
                total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()),
                                          pa.array([total.tobytes()], pa.binary())], ["task", "total"])

    def meet(table: pa.Table) -> pa.Table:
        table = table.sort_by("task")
        total = np.sum([np.frombuffer(x) for x in table.column("total").to_pylist()], 0)
        return pa.table({"task": pa.array([table.column("task")[0].as_py() // fan_in], pa.int64()),
                         "total": pa.array([total.tobytes()], pa.binary())})

    parts = vectors.select("embedding").mapInArrow(run, "task long, total binary")
    for _ in range(levels):
        parts = parts.groupBy(F.floor(F.col("task") / fan_in).alias("to")).applyInArrow(meet, parts.schema)
    whole = parts.groupBy(F.lit(0).alias("to")).applyInArrow(meet, parts.schema).first()
    return np.frombuffer(whole["total"]).reshape(width, width)


def fit(vectors: DataFrame, components: int = 8, block: int = BLOCK) -> Fit | None:
    """The leading components of all usable rows of ``vectors`` (column ``embedding``); None without a usable row.

    Tasks keep the spectrum of what they have read up to date by centred rank-one updates (``Spectrum``); spectra
    meet in a tree. The combined eigenvectors then are the basis of a Rayleigh-Ritz step over all rows: the
    projected, centred rows' products are summed up on the executors, and the small matrix they make is diagonalised. That takes
    out what rounding has left over many updates. Directions without variance give no component.
    """
    size = dimension(vectors)
    found = combined(spectra(vectors, size, block)) if size else None
    if found is None:
        return None
    n, sums, whole = found
    basis = np.linalg.qr(whole.vectors[:, ::-1])[0]
    rough = Fit(n, sums, basis, np.ones(size), 0.0)
    small = _products(vectors, size, lambda x: rough.centred(x) @ basis, size) / n
    values, turned = np.linalg.eigh((small + small.T) / 2)
    values, turned = values[::-1], (basis @ turned)[:, ::-1]
    trace = float(np.trace(small))
    keep = int((values[:components] > FLAT * max(trace, 0.0)).sum())
    axes = turned[:, :keep]
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(keep)] < 0, -1.0, 1.0) if keep else axes
    out = Fit(n, sums, axes, values[:keep], trace)
    if keep:
        # Whitened columns have mean 0, being centred before they are projected.
        spread = _products(vectors, size, out.whitened, keep) / n
        out.identity_error = float(np.abs(spread - np.eye(keep)).max())
    return out


def whitened(vectors: DataFrame, components: int = 8, block: int = BLOCK) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per usable vector and component.

    ``vectors`` has vec_id and embedding. Rows whose vector is null, empty, or holds a null or non-finite entry take
    no part, nor do vectors of another length than most have. Entries become ``x = floor(1024 c) + 100000``.
    ``deviation`` is the exact sum of ``(n x - S)^2`` as decimal(38, 0). Components are numbered by falling
    eigenvalue; one without variance (all vectors equal, fewer vectors than components) gives no rows. Each component's
    largest entry is positive. Repeated rows and ids, and rows without an id, count each for itself. Further columns
    are not read.
    """
    ship_package(vectors.sparkSession)
    model = fit(vectors, components, block)
    schema = ("vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, "
              "identity_error double")
    names = [p.split()[0] for p in schema.replace("decimal(38,0)", "decimal").split(", ")]
    if model is None or not len(model.eigenvalues):
        return vectors.sparkSession.createDataFrame([], schema)
    size, k = model.components.shape
    share = model.eigenvalues / model.trace

    def deviation(x: np.ndarray) -> pa.Array:
        # Whole numbers throughout; where 64 bits could be too few, Python's own.
        most = max(abs(int(x.max()) * model.n - min(model.sums)), abs(int(x.min()) * model.n - max(model.sums)))
        kind = np.int64 if most * most * size < 1 << 63 and model.n * int(np.abs(x).max()) < 1 << 62 else object
        gaps = x.astype(kind) * model.n - np.array(model.sums, kind)
        total = (gaps * gaps).sum(1)
        if kind is object:
            from decimal import Decimal

            return pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))
        return pa.array(total).cast(pa.decimal128(38, 0))

    def run(batches):
        for batch in batches:
            rows, x = entries(batch, size)
            for first in range(0, len(rows), 4096):
                part, own = rows[first:first + 4096], x[first:first + 4096]
                many = len(part)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").take(pa.array(np.repeat(part, k))),
                     pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), many)), pa.array(np.full(many * k, model.n)),
                     deviation(own).take(pa.array(np.repeat(np.arange(many), k))), pa.array(model.whitened(own).ravel()),
                     pa.array(np.tile(share, many)), pa.array(np.full(many * k, model.identity_error))], names)

    return vectors.select("vec_id", "embedding").mapInArrow(run, schema)
