"""Score days against a person's own history: cold start and forecaster."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwatch.config import DAY, DEFAULTS, FEATURES, KEY, Settings
from driftwatch.functions.text import add, deviation, each, num, weighted
from driftwatch.operators.asof import as_of_join
from driftwatch.operators.ewma import ewma_states, ewma_std

FLAT = 1e-9  # fixed value: a deviation below this counts as constant


def cold_start(days: DataFrame, s: Settings = DEFAULTS, keys: Sequence[str] = (KEY,)) -> DataFrame:
    """Weighted mean |z| of each day against the last ``fallback_lookback`` rows before it.

    A feature with fewer than two past values, no value today or a constant past gives
    z = 0 and keeps its weight. The score is NULL with fewer than ``fallback_min_days`` rows.
    """
    w = (f" OVER (PARTITION BY {', '.join(keys)} ORDER BY {DAY} ROWS BETWEEN {s.fallback_lookback} PRECEDING "
         "AND 1 PRECEDING)")
    df = add(days, f"count(1){w} AS hist_n", each("count({f})" + w + " AS _n_{f}"), each("avg({f})" + w + " AS _m_{f}"),
             each(deviation("{f}", w) + " AS _s_{f}"))
    ok = "_n_{f} >= 2 AND {f} IS NOT NULL AND _s_{f} >= " + num(FLAT)
    df = df.selectExpr(*days.columns, "hist_n",
                       *each("CASE WHEN " + ok + " THEN ({f} - _m_{f}) / _s_{f} ELSE 0D END AS z_{f}"))
    df = add(df, f"CASE WHEN hist_n >= {s.fallback_min_days} THEN {weighted('abs(z_{f})', s)} END AS fallback_score")
    return add(df, f"fallback_score > {num(s.fallback_sigma)} AS fallback_deviation")


def latest_baseline(baselines: DataFrame) -> DataFrame:
    """The newest version of each person's baseline."""
    others = [c for c in baselines.columns if c != KEY]
    return (baselines.groupBy(KEY).agg(F.max_by(F.struct(*others), "version").alias("_b"))
            .select(KEY, "_b.*"))


def with_first_training(baselines: DataFrame) -> DataFrame:
    """``first_trained``: the day of a person's first version, which later versions carry on.

    Judgement, the observation period and the running state start there and outlive a retrain.
    """
    first = "coalesce(first_train_date, train_date)" if "first_train_date" in baselines.columns else "train_date"
    return add(baselines, f"min({first}) OVER (PARTITION BY {KEY}) AS first_trained")


def attach_baseline(days: DataFrame, baselines: DataFrame, as_of: bool = True) -> DataFrame:
    """Days with their baseline columns; NULL where the person has none (yet).

    By default each day takes the version trained last before it; ``as_of=False`` takes the
    newest version for all days.
    """
    known = with_first_training(baselines)
    if as_of:
        return as_of_join(days, known, [KEY], DAY, "train_date")
    return days.join(latest_baseline(known), KEY, "left")


def _last_week(s: Settings) -> str:
    return f" OVER (PARTITION BY {KEY} ORDER BY {DAY} RANGE BETWEEN {s.window} PRECEDING AND 1 PRECEDING)"


def mean_forecast(days: DataFrame, s: Settings = DEFAULTS, valid_only: bool = False) -> DataFrame:
    """Mean of the previous ``window`` calendar days, and how many of them exist."""
    w = _last_week(s)
    use = "CASE WHEN valid THEN {f} END" if valid_only else "{f}"
    return add(days, f"count({use.format(f=1)}){w} AS n_hist", each("avg(" + use + ")" + w + " AS past_{f}"))


def window_rows(days: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """The previous ``window`` calendar days as an array of vectors, oldest first."""
    w = _last_week(s)
    return add(days, f"count(1){w} AS n_hist",
               f"transform(array_sort(collect_list(struct({DAY}, array({', '.join(FEATURES)}) AS v)){w}), r -> r.v)"
               " AS history")


def predict_mean(df: DataFrame) -> DataFrame:
    """Normalised prediction of the moving-average forecaster from ``past_<f>``."""
    return add(df, each("(past_{f} - scaler_mean[{i}]) / scaler_scale[{i}] AS pred_{f}"))


def residuals(df: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """``signed_<f>`` (actual - predicted), ``res_<f>`` and the weighted score.

    Needs normalised predictions ``pred_<f>`` and the baseline's scaler arrays.
    """
    df = add(df, each("({f} - scaler_mean[{i}]) / scaler_scale[{i}] - pred_{f} AS signed_{f}"))
    df = add(df, each("abs(signed_{f}) AS res_{f}"))
    return add(df, weighted("res_{f}", s) + " AS anomaly_score")


AT_TRAINING = ("ewma_mean_at_train", "ewma_var_at_train", "ewma_n_at_train")


def decide(scored: DataFrame, s: Settings = DEFAULTS, flag: str = "scored",
           seed: tuple[str, str, str] = AT_TRAINING) -> DataFrame:
    """Thresholds, deviation flag and status of rows that have a score.

    Today is compared with the state before today and then added to it, deviating or not.
    Rows whose ``flag`` is false pass by without touching the state, which goes on from ``seed``.
    """
    df = ewma_states(scored, [KEY], [DAY], "anomaly_score", s.ewma_alpha,
                     seed=seed, only=flag)
    std_before = ewma_std("var_before", "n_before")
    df = add(df, f"CASE WHEN n_before >= {s.ewma_min_samples} THEN mean_before + {num(s.sigma)} * {std_before} "
                 "ELSE static_threshold END AS ewma_threshold")
    df = add(df, "least(static_threshold, ewma_threshold) AS dynamic_threshold")
    return add(df, "anomaly_score > dynamic_threshold AS is_deviation",
               f"ewma_n - coalesce(ewma_n_at_train, 0) <= {s.observation_days} AS in_observation_period",
               f"{ewma_std('ewma_var', 'ewma_n')} AS ewma_std")
