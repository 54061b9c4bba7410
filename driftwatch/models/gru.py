"""One small recurrent forecaster per person, trained and applied as many-models jobs.

Spark gathers each person's few training rows into one record; a task then trains a whole
Arrow batch of people at once, as one stack of matrices, instead of looping over them. Each
person's start values come from a hash of the key, so the result depends neither on
partitioning nor on the company a person is trained in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwatch.config import DAY, DEFAULTS, FEATURES, KEY, Settings
from driftwatch.functions.text import add, each
from driftwatch.operators.baseline import RESIDUAL_STATS, blend_stats, finish_baseline, static_threshold
from driftwatch.session import shuffle_width

D = len(FEATURES)
IMPROVED_BY = 1e-6       # fixed value: smallest drop of the loss that counts
ADAM = (0.9, 0.999, 1e-8)  # fixed values: the optimizer's usual decay rates
AT_ONCE = 64             # people trained as one stack

_ARR = T.ArrayType(T.DoubleType())
_FITTED = [("weights", _ARR), ("resid_mean", _ARR), ("resid_std", _ARR), ("signed_mean", _ARR), ("signed_std", _ARR),
           ("train_scores", _ARR), ("first_loss", T.DoubleType()), ("best_loss", T.DoubleType()),
           ("epochs_run", T.IntegerType())]
_CONSUMED = ("rows", "seed", "start")


def shapes(hidden: int) -> list[tuple[int, ...]]:
    """Input, recurrent and output matrices and their biases, in storage order."""
    return [(3 * hidden, D), (3 * hidden, hidden), (3 * hidden,), (3 * hidden,), (D, hidden), (D,)]


def n_parameters(hidden: int) -> int:
    return sum(int(np.prod(s)) for s in shapes(hidden))


def _split(theta: np.ndarray, hidden: int) -> list[np.ndarray]:
    """(people, parameters) -> one stacked array per matrix."""
    out, at = [], 0
    for s in shapes(hidden):
        size = int(np.prod(s))
        out.append(theta[:, at:at + size].reshape(len(theta), *s))
        at += size
    return out


def initial(seeds: np.ndarray, hidden: int) -> np.ndarray:
    """Uniform start values of every person from their own seed."""
    bound = 1.0 / np.sqrt(hidden)
    return np.stack([np.random.default_rng(int(s) & 0xFFFFFFFF).uniform(-bound, bound, n_parameters(hidden))
                     for s in seeds])


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-x))


def forward(theta: np.ndarray, x: np.ndarray, hidden: int, keep: np.ndarray | float = 1.0, tape: list | None = None):
    """Predictions (people, windows, D) and last states for x of (people, windows, days, D)."""
    w_in, w_rec, b_in, b_rec, w_out, b_out = _split(theta, hidden)
    h = np.zeros((*x.shape[:2], hidden))
    flat = x.reshape(len(x), -1, x.shape[-1])
    gates_in = (flat @ w_in.transpose(0, 2, 1) + b_in[:, None]).reshape(*x.shape[:3], -1)
    w_rec_t = w_rec.transpose(0, 2, 1)
    for t in range(x.shape[2]):
        a, b = gates_in[:, :, t], h @ w_rec_t + b_rec[:, None]
        r, z = np.split(_sigmoid(a[..., :2 * hidden] + b[..., :2 * hidden]), 2, axis=-1)
        cand_rec = b[..., 2 * hidden:]
        cand = np.tanh(a[..., 2 * hidden:] + r * cand_rec)
        if tape is not None:
            tape.append((h, r, z, cand, cand_rec))
        h = (1 - z) * cand + z * h
    return (h * keep) @ w_out.transpose(0, 2, 1) + b_out[:, None], h


def loss_and_gradient(theta, x, y, mask, hidden, keep=1.0):
    """Mean squared error per person over its real windows, and its gradient."""
    tape: list = []
    pred, last = forward(theta, x, hidden, keep, tape)
    _, w_rec, _, _, w_out, _ = _split(theta, hidden)
    scale = (mask / (np.maximum(mask.sum(1, keepdims=True), 1) * D))[..., None]
    diff = pred - y
    loss = (diff ** 2 * scale).sum((1, 2))
    d_out = 2 * diff * scale
    kept = last * keep
    g_out, gb_out = d_out.transpose(0, 2, 1) @ kept, d_out.sum(1)
    dh = (d_out @ w_out) * keep
    d_in, d_rec = np.empty((*x.shape[:3], 3 * hidden)), np.empty((*x.shape[:3], 3 * hidden))
    before = np.empty((*x.shape[:3], hidden))
    for t in range(x.shape[2] - 1, -1, -1):
        h, r, z, cand, cand_rec = tape[t]
        a, b = d_in[:, :, t], d_rec[:, :, t]
        d_cand = dh * (1 - z) * (1 - cand ** 2)
        a[..., :hidden] = d_cand * cand_rec * r * (1 - r)
        a[..., hidden:2 * hidden] = dh * (h - cand) * z * (1 - z)
        a[..., 2 * hidden:] = d_cand
        b[..., :2 * hidden] = a[..., :2 * hidden]
        b[..., 2 * hidden:] = d_cand * r
        before[:, :, t] = h
        dh = dh * z + b @ w_rec
    rows = lambda g: g.reshape(len(theta), -1, g.shape[-1])
    d_in, d_rec = rows(d_in), rows(d_rec)
    g_in, g_rec = d_in.transpose(0, 2, 1) @ rows(x), d_rec.transpose(0, 2, 1) @ rows(before)
    gb_in, gb_rec = d_in.sum(1), d_rec.sum(1)
    n = len(theta)
    grad = np.concatenate([g.reshape(n, -1) for g in (g_in, g_rec, gb_in, gb_rec, g_out, gb_out)], axis=1)
    return loss, grad


def fit(theta, x, y, mask, seeds, hidden, epochs, lr, patience=0, dropout=0.0):
    """Adam on every person at once; those whose loss stalls stand still while others go on.

    With ``patience`` the best parameters seen are returned, otherwise the last ones.
    """
    b1, b2, eps = ADAM
    theta = theta.copy()
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    best, best_loss = theta.copy(), np.full(len(theta), np.inf)
    stalled, ran = np.zeros(len(theta), int), np.zeros(len(theta), int)
    active = np.ones(len(theta), bool)
    rngs = [np.random.default_rng([int(s) & 0xFFFFFFFF, 1]) for s in seeds] if dropout else []
    first = None
    for step in range(1, epochs + 1):
        go = np.flatnonzero(active)
        if not len(go):
            break
        keep = 1.0
        if dropout:
            # one mask per person and real window, so padding never shifts a person's stream
            keep = np.zeros((len(go), x.shape[1], hidden))
            for i, p in enumerate(go):
                n = int(mask[p].sum())
                keep[i, :n] = (rngs[p].random((n, hidden)) >= dropout) / (1 - dropout)
        loss, grad = loss_and_gradient(theta[go], x[go], y[go], mask[go], hidden, keep)
        first = loss.copy() if first is None else first
        ran[go] = step
        better = loss < best_loss[go] - IMPROVED_BY
        best[go[better]] = theta[go[better]]
        best_loss[go[better]] = loss[better]
        stalled[go] = np.where(better, 0, stalled[go] + 1)
        mg, vg = b1 * m[go] + (1 - b1) * grad, b2 * v[go] + (1 - b2) * grad ** 2
        m[go], v[go] = mg, vg
        theta[go] -= lr / (1 - b1 ** step) * mg / (np.sqrt(vg / (1 - b2 ** step)) + eps)
        if patience:
            active[go] = stalled[go] < patience
    return (best if patience else theta), first, best_loss, ran


def windows(rows: list[np.ndarray], window: int):
    """Per person a matrix of days -> padded windows, targets and a mask of real ones."""
    most = max(len(r) - window for r in rows)
    x, y = np.zeros((len(rows), most, window, D)), np.zeros((len(rows), most, D))
    mask = np.zeros((len(rows), most))
    for p, r in enumerate(rows):
        n = len(r) - window
        x[p, :n] = np.lib.stride_tricks.sliding_window_view(r, (window, D))[:n, 0]
        y[p, :n] = r[window:]
        mask[p, :n] = 1
    return x, y, mask


def _trainer(s: Settings, finetune: bool):
    share = np.array([s.weight(f) for f in FEATURES]) / s.weight_sum

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), AT_ONCE):
                part = pdf.iloc[at:at + AT_ONCE]
                rows = [np.asarray(r, dtype=float).reshape(-1, D) for r in part["rows"]]
                seeds = part["seed"].to_numpy()
                x, y, mask = windows(rows, s.window)
                if finetune:
                    start = np.stack([np.asarray(w, dtype=float) for w in part["start"]])
                    theta, first, best, ran = fit(start, x, y, mask, seeds, s.hidden, s.finetune_epochs,
                                                  s.finetune_lr, 0, s.dropout)
                else:
                    theta, first, best, ran = fit(initial(seeds, s.hidden), x, y, mask, seeds, s.hidden, s.epochs,
                                                  s.lr, s.patience, s.dropout)
                pred, _ = forward(theta, x, s.hidden)
                out = []
                for p in range(len(rows)):
                    n = int(mask[p].sum())
                    signed = y[p, :n] - pred[p, :n]
                    size = np.abs(signed)
                    out.append((list(theta[p]), list(size.mean(0)), list(size.std(0)), list(signed.mean(0)),
                                list(signed.std(0)), list(size @ share), first[p], best[p], int(ran[p])))
                fitted = pd.DataFrame(out, columns=[n for n, _ in _FITTED])
                passed = part.drop(columns=[c for c in _CONSUMED if c in part])
                yield pd.concat([passed.reset_index(drop=True), fitted], axis=1)

    return run


def _fit_people(people: DataFrame, s: Settings, finetune: bool) -> DataFrame:
    """Train every row's person; the other columns of the row come out again beside the fit.

    Training is heavy for its size, so the small records are spread over as many partitions as
    the session asks for; partitions merged by byte count would leave cores idle.
    """
    passed = [f for f in people.schema.fields if f.name not in _CONSUMED]
    schema = T.StructType(passed + [T.StructField(n, t) for n, t in _FITTED])
    spread = people.repartition(shuffle_width(people.sparkSession), "seed")
    return spread.mapInPandas(_trainer(s, finetune), schema)


def _matrix(norm: str) -> Column:
    """A person's normalised days, oldest first, as one flat array of at most ~30 days."""
    row = F.expr(f"array({', '.join(each(norm))})")
    return F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(DAY, row.alias("v")))), lambda r: r["v"]))


def train(marked_windows: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Baseline rows (version 1) with trained weights for everyone who passed the gate.

    ``marked_windows`` comes from ``baseline.mark_windows``; the scaler fitted there is used.
    """
    kept = marked_windows.filter("enrol AND NOT outlier_day AND gate = 'ok'")
    people = kept.groupBy(KEY).agg(
        _matrix("({f} - mean_{f}) / scale_{f}").alias("rows"),
        F.max("train_date").alias("train_date"), F.max("n_train_days").cast("long").alias("n_train_days"),
        F.expr(f"array({', '.join(each('max(mean_{f})'))})").alias("scaler_mean"),
        F.expr(f"array({', '.join(each('max(scale_{f})'))})").alias("scaler_scale"),
    ).withColumn("seed", F.xxhash64(KEY))
    fitted = _fit_people(people, s, False).withColumn("n_windows", F.size("train_scores").cast("long"))
    return finish_baseline(fitted, F.col("train_scores"), "gru", s).withColumn("hidden_dim", F.lit(s.hidden))


def finetune(recent_days: DataFrame, baselines: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Next version for everyone in ``recent_days`` who has a trained network.

    The scaler is kept as it is; residual statistics are blended with the old ones; the
    EWMA state at training is carried over.
    """
    base = baselines.filter(F.col("model") == "gru")
    others = [c for c in base.columns if c != KEY]
    joined = recent_days.join(base.select(KEY, F.struct(*others).alias("old")), KEY)
    people = joined.groupBy(KEY).agg(
        _matrix("({f} - old.scaler_mean[{i}]) / old.scaler_scale[{i}]").alias("rows"), F.first("old").alias("old"),
        F.max(DAY).alias("tuned_on"),
    ).selectExpr(KEY, "rows", "tuned_on", "old.weights AS start", f"xxhash64({KEY}) AS seed",
                 *[f"old.{c} AS old_{c}" for c in others])
    new = _fit_people(people, s, True)
    replaced = {"weights", "first_loss", "best_loss", "epochs_run", "train_scores"}
    tuned = new.selectExpr(KEY, *[c if c in replaced else {
        "version": "old_version + 1 AS version", "train_date": "tuned_on AS train_date",
        "n_windows": "CAST(size(train_scores) AS BIGINT) AS n_windows",
    }.get(c, blend_stats(c, f"old_{c}", c, s) if c in RESIDUAL_STATS else f"old_{c} AS {c}") for c in others])
    return tuned.drop("static_threshold").withColumn(
        "static_threshold", F.expr(static_threshold("resid_mean", "resid_std", s))).select(*base.columns)


def predictor(s: Settings = DEFAULTS):
    """Predictor for ``plans.daily.score_days``: adds ``pred_<f>`` and ``hidden_state``."""
    hidden, window = s.hidden, s.window
    kind = T.StructType([T.StructField("pred", _ARR), T.StructField("state", _ARR)])

    @F.pandas_udf(kind)
    def step(history: pd.Series, weights: pd.Series) -> pd.DataFrame:
        n = len(history)
        pred, state = [None] * n, [None] * n
        ready = [i for i in range(n) if weights.iloc[i] is not None and history.iloc[i] is not None
                 and len(history.iloc[i]) == window * D]
        for at in range(0, len(ready), AT_ONCE):
            idx = ready[at:at + AT_ONCE]
            x = np.stack([np.asarray(history.iloc[i], dtype=float).reshape(1, window, D) for i in idx])
            theta = np.stack([np.asarray(weights.iloc[i], dtype=float) for i in idx])
            out, last = forward(theta, x, hidden)
            for j, i in enumerate(idx):
                pred[i], state[i] = list(out[j, 0]), list(last[j, 0])
        return pd.DataFrame({"pred": pred, "state": state})

    def add_predictions(rows: DataFrame) -> DataFrame:
        norm = "flatten(transform(history, v -> transform(v, (x, i) -> (x - scaler_mean[i]) / scaler_scale[i])))"
        df = rows.withColumn("_g", step(F.expr(f"CASE WHEN scored THEN {norm} END"),
                                        F.expr("CASE WHEN scored THEN weights END")))
        return add(df, each("_g.pred[{i}] AS pred_{f}"), "_g.state AS hidden_state").drop("_g")

    return add_predictions
