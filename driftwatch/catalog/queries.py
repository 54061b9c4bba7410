"""Named queries over the driver tables: one per operator or job.

Dates come out as text and doubles rounded to six digits, so that two engines that add in
different orders give equal values.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwatch.config import DAY, FEATURES, KEY, RISK_RULES, Settings
from driftwatch.functions.text import add, array, each
from driftwatch.operators import (acoustic, activity, alerts, assemble, baseline, dialogue, ewma, health, metrics,
                                  quality, report, risk, scoring, sketch, sleep, social)
from driftwatch.operators.asof import as_of_join
from driftwatch.plans import daily, handoff, steps, weekly
from driftwatch.session import ensure_session
from driftwatch.sources import events as ev
from driftwatch.sources import changes, tables
from driftwatch.streaming import live, stateful

Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, Query] = {}

KD = [KEY, DAY]
ARRIVAL = ["ts", "event_id"]
# Lower limits, so that a short history shows deviations, streaks, all levels and types.
SENSITIVE = Settings(sigma=0.25, fallback_sigma=1.0, observation_days=1, ewma_min_samples=8)
GENERATED_AT = "2024-02-01 00:00"


def query(fn: Query) -> Query:
    """Register ``fn`` under its own name, with the session settings results depend on."""
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return fn(ensure_session(spark), folder)

    CATALOG[fn.__name__] = run
    return fn


# Values with few decimals often lie exactly between two roundings, where the last bit of a
# sum decides; the shift moves those borders to values that do not occur.
TIE_SHIFT = 3.3e-8


def six_digits(x: Column) -> Column:
    """``x`` to six digits by scaling, as SQL engines do. ``F.round(x, 6)`` rounds the shortest decimal text of ``x``, which
    has no digits to spare in numbers of nine places before the point and so may go the wrong way."""
    return F.round(x * 1e6) / 1e6


def tidy(df: DataFrame) -> DataFrame:
    """Comparable output: rounded doubles, dates as text, instants in microseconds."""
    out = []
    for name, kind in df.dtypes:
        if kind == "double":
            out.append(six_digits(F.col(name) + TIE_SHIFT).alias(name))
        elif kind == "date":
            out.append(F.col(name).cast("string").alias(name))
        elif kind == "timestamp":
            out.append(F.unix_micros(name).alias(name))
        elif kind == "array<string>":
            out.append(F.array_join(name, ",").alias(name))
        elif kind in ("int", "smallint", "tinyint"):
            out.append(F.col(name).cast("long").alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


# ---- inputs --------------------------------------------------------------

def _events(spark, d):
    return ev.events(spark, d)


def _utterances(spark, d):
    return ev.utterances(_events(spark, d))


def _daily(spark, d):
    return ev.daily_vectors(_utterances(spark, d))


def _days(spark, d):
    return daily.labelled_days(_daily(spark, d))


def _valid(spark, d):
    return _days(spark, d).filter("stored AND valid")


def _marked(spark, d):
    return health.flag_outliers(health.mark_enrolment(_days(spark, d).filter("stored")))


def _windows(spark, d):
    return baseline.mark_windows(_marked(spark, d))


def _cold(spark, d, s=Settings()):
    """Cold-start results of valid days, in the shape of stored results."""
    df = scoring.cold_start(_valid(spark, d), s).filter("fallback_score IS NOT NULL")
    return df.selectExpr(KEY, DAY, "fallback_score AS anomaly_score", "fallback_deviation AS is_deviation",
                         *each("z_{f}"))


def _results(spark, d, s=SENSITIVE):
    return daily.daily_job(_daily(spark, d), s)


# ---- feature extraction --------------------------------------------------

@query
def daily_acoustic(spark, d):
    return tidy(acoustic.stream_features(_utterances(spark, d), KD, digits=False))


@query
def daily_acoustic_batch(spark, d):
    e = _events(spark, d)
    return tidy(acoustic.batch_features(ev.batch_utterances(e), KD, ev.sounds(e), digits=False))


@query
def sleep_features(spark, d):
    e = _events(spark, d)
    return tidy(sleep.sleep_features(ev.waveform(e), ev.nights(e), KD, ARRIVAL, digits=False))


@query
def activity_from_motion(spark, d):
    return tidy(activity.daily_activity(KD, pir=ev.motion(_events(spark, d)), digits=False))


@query
def activity_by_precedence(spark, d):
    """Reported seconds on some days, joint paths on the others, and the constant."""
    e = _events(spark, d)
    reported = e.filter(F.col("event_type") == "purchase").select(
        *KD, (F.col("k") * 3600.0).alias("activity_seconds"))
    return tidy(activity.daily_activity(KD, reported=reported, frames=ev.frames(e), days=e, digits=False))


@query
def joint_displacement(spark, d):
    return tidy(activity.joint_displacement(ev.frames(_events(spark, d)), KD))


@query
def room_entropy(spark, d):
    return tidy(activity.room_entropy(ev.motion(_events(spark, d)), KD, ARRIVAL, digits=False))


@query
def social_features(spark, d):
    """Turns from voice segments (gap of an hour) plus speaker logs on purchase events."""
    e = _events(spark, d)
    log = e.filter(F.col("event_type") == "purchase").select(*KD, F.when(F.col("k") > 20, F.col("k")).alias("utterances"))
    seg = ev.voice_segments(e.filter(F.col("event_type") != "purchase"))
    return tidy(social.social_features(KD, seg, ARRIVAL, speaker_log=log, gap_seconds=3600.0, digits=False))


@query
def social_features_strict_gap(spark, d):
    return tidy(social.social_features(KD, ev.voice_segments(_events(spark, d)), ARRIVAL, digits=False))


# ---- assembly and quality ------------------------------------------------

@query
def daily_vectors(spark, d):
    return tidy(_daily(spark, d))


@query
def assembled_days(spark, d):
    """Modalities kept apart, each missing on some days, and put together again."""
    day = _daily(spark, d)
    part = {m: day.filter(F.pmod(F.col(KEY) + F.dayofmonth(DAY), F.lit(n)) != 0)
            for m, n in (("acoustic", 5), ("sleep", 7), ("activity", 3), ("social", 4))}
    return tidy(assemble.assemble(part))


@query
def quality_labels(spark, d):
    return tidy(_days(spark, d))


@query
def quality_summary(spark, d):
    return tidy(quality.quality_summary(_days(spark, d)))


@query
def imputed_sequence(spark, d):
    return tidy(quality.impute_sequence(quality.calendar_spine(_daily(spark, d))))


@query
def degraded_days(spark, d):
    return tidy(quality.degraded_days(quality.impute_sequence(quality.calendar_spine(_daily(spark, d)))))


@query
def feature_range(spark, d):
    return tidy(tables.between(_daily(spark, d), "2024-01-05", "2024-01-18"))


@query
def recent_days(spark, d):
    return tidy(tables.last_days(_daily(spark, d), 7))


@query
def deduplicated_days(spark, d):
    """A table with every day written twice, collapsed to one row per day."""
    day = assemble.with_missing(_daily(spark, d)).withColumnRenamed("missing_raw", "missing_count").drop("missing_names")
    worse = day.withColumn("missing_count", F.col("missing_count") + 1).withColumn("sad_ratio", F.lit(9.0))
    return tidy(tables.one_row_per_day(day.unionByName(worse)))


# ---- enrolment and baselines --------------------------------------------

@query
def outlier_days(spark, d):
    return tidy(health.outlier_days(_marked(spark, d)))


@query
def outlier_text(spark, d):
    return tidy(health.describe_outliers(_marked(spark, d)))


@query
def training_gate(spark, d):
    return tidy(health.training_gate(_marked(spark, d)))


@query
def scaled_days(spark, d):
    """All valid days in units of the scaler fitted on the clean enrolment days."""
    scaler = baseline.fit_scaler(health.training_days(_marked(spark, d)))
    return tidy(baseline.apply_scaler(_valid(spark, d).select(*KD, *FEATURES), scaler))


@query
def training_windows(spark, d):
    return tidy(_windows(spark, d).filter("is_window").select(*KD, *[f"train_{f}" for f in FEATURES], "train_score"))


def _long_baselines(base):
    names = ", ".join(f"'{f}'" for f in FEATURES)
    arrays = ["scaler_mean", "scaler_scale", "resid_mean", "resid_std", "signed_mean", "signed_std"]
    df = base.selectExpr(KEY, "train_date", "n_train_days", "n_windows", "static_threshold", "ewma_n_at_train",
                         "ewma_mean_at_train", "ewma_var_at_train",
                         f"posexplode(arrays_zip({', '.join(arrays)})) AS (pos, s)")
    return df.selectExpr(KEY, "train_date", "n_train_days", "n_windows", "static_threshold", "ewma_n_at_train",
                         "ewma_mean_at_train", "ewma_var_at_train", f"element_at(array({names}), pos + 1) AS feature",
                         *[f"s.{a} AS {a}" for a in arrays])


@query
def mean_baselines(spark, d):
    return tidy(_long_baselines(baseline.mean_baselines(_windows(spark, d))))


@query
def scaler_report(spark, d):
    return tidy(baseline.scaler_report(baseline.mean_baselines(_windows(spark, d))))


@query
def baseline_as_of(spark, d):
    """Each stored day with the baseline that was trained before it, if any."""
    base = baseline.mean_baselines(_windows(spark, d)).select(KEY, "train_date", "static_threshold")
    return tidy(as_of_join(_days(spark, d).filter("stored").select(*KD), base, [KEY], DAY, "train_date"))


@query
def finetune_days(spark, d):
    """Recent valid days without deviation days (cold-start rule at 1 sigma)."""
    bad = _cold(spark, d, Settings(fallback_sigma=1.0)).filter("is_deviation")
    return tidy(baseline.finetune_days(_valid(spark, d).select(*KD, *FEATURES), bad))


@query
def merged_residual_stats(spark, d):
    """Statistics at training blended with those of the fine-tune days, for everyone with a baseline."""
    old = baseline.mean_baselines(_windows(spark, d))
    bad = _cold(spark, d, Settings(fallback_sigma=1.0)).filter("is_deviation")
    recent = baseline.recent_stats(baseline.finetune_days(_valid(spark, d), bad), old)
    return tidy(_long_baselines(baseline.merge_residual_stats(old, recent)).select(
        KEY, "feature", "resid_mean", "resid_std", "signed_mean", "signed_std"))


@query
def weekly_baselines(spark, d):
    """Second versions of the moving-average baselines from recent days without deviations (cold start at 1 sigma)."""
    bad = _cold(spark, d, Settings(fallback_sigma=1.0)).withColumn("saved", F.lit(True))
    out = weekly.retrain(_days(spark, d), bad, baseline.mean_baselines(_windows(spark, d)))
    return tidy(_long_baselines(out))


# ---- scoring -------------------------------------------------------------

@query
def cold_start_scores(spark, d):
    return tidy(_cold(spark, d))


@query
def mean_forecast(spark, d):
    return tidy(scoring.mean_forecast(_days(spark, d).filter("stored")).select(
        *KD, "n_hist", *[f"past_{f}" for f in FEATURES]))


@query
def ewma_states(spark, d):
    """EWMA before and after each cold-start score, with its threshold."""
    df = ewma.ewma_states(_cold(spark, d), [KEY], [DAY], "anomaly_score")
    df = add(df, f"{ewma.ewma_std('ewma_var', 'ewma_n')} AS ewma_std",
             f"{ewma.ewma_threshold('mean_before', 'var_before', 'n_before', 2.5)} AS threshold_before")
    return tidy(df.select(*KD, "n_before", "mean_before", "var_before", "ewma_n", "ewma_mean", "ewma_var", "ewma_std",
                          "threshold_before"))


@query
def ewma_final(spark, d):
    return tidy(ewma.ewma_fold(_cold(spark, d), [KEY], DAY, "anomaly_score"))


@query
def score_percentiles(spark, d):
    return tidy(ewma.score_percentile(_cold(spark, d), [KEY], "anomaly_score", 90.0, "max(anomaly_score) + 2.5D"))


@query
def score_percentiles_merged(spark, d):
    """Sketches per person and week, added up per person: no second look at the scores."""
    weekly = sketch.score_sketches(_cold(spark, d).withColumn("week", F.date_trunc("week", DAY)), [KEY, "week"])
    return tidy(sketch.sketch_percentile(sketch.merged_sketches(weekly, [KEY]), 90.0))


RESULT_COLUMNS = [KEY, DAY, "data_quality", "missing_count", "status", "anomaly_score", "static_threshold",
                  "ewma_threshold", "dynamic_threshold", "is_deviation", "in_observation_period", "ewma_n", "ewma_mean",
                  "ewma_std", "judged_streak", "consecutive_deviation_days", "reported_streak", "avg_anomaly_7d",
                  "max_anomaly_7d", "risk_level", "risk_label", "risk_types", "recommendation"]


def _result_table(df: DataFrame) -> DataFrame:
    """Result columns; counts that may be NULL as doubles, which any client shows alike."""
    counts = {"ewma_n", "judged_streak", "consecutive_deviation_days", "reported_streak", "risk_level"}
    return tidy(df.select(*[F.col(c).cast("double").alias(c) if c in counts else F.col(c) for c in RESULT_COLUMNS],
                          *[f"res_{f}" for f in FEATURES]))


@query
def daily_results(spark, d):
    """The whole daily job at its default thresholds."""
    return _result_table(_results(spark, d, Settings()))


def _stored_days(spark, d):
    """Labelled days, worked out once for all that reads them."""
    path = live.work_folder(spark, "days")
    _days(spark, d).write.parquet(path)
    return spark.read.parquet(path)


def _stored_baselines(spark, first: DataFrame, later: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The table of ``first`` versions, and of the version that ``later`` makes of the stored ones."""
    path = live.work_folder(spark, "baselines")
    tables.append_baselines(first, path)
    if later:
        tables.append_baselines(later(spark.read.parquet(path)), path)
    return spark.read.parquet(path)


@query
def daily_results_stored(spark, d):
    """The daily job with baselines from the baseline table; equal to the job that makes them in passing."""
    days = _stored_days(spark, d)
    base = _stored_baselines(spark, daily.first_baselines(days))
    return _result_table(daily.judge_days(daily.score_days(days, base)))


@query
def daily_results_two_versions(spark, d):
    """A second version with half the static threshold, trained nine days later: days after it are judged by it, while
    the running state and the observation period go on from the first."""
    days = _stored_days(spark, d)
    base = _stored_baselines(spark, daily.first_baselines(days), lambda first: first.withColumns({
        "version": F.lit(2), "train_date": F.date_add("train_date", 9), "static_threshold": F.col("static_threshold") / 2}))
    return _result_table(daily.judge_days(daily.score_days(days, base)))


@query
def daily_results_sensitive(spark, d):
    """The daily job with low limits."""
    return _result_table(_results(spark, d))


@query
def daily_results_by_steps(spark, d):
    """The daily job from a state per person: ten days to catch up, then day by day where most people finish enrolment,
    ten days at once, one day, and the rest. Equal to the whole run."""
    features = live.work_folder(spark, "features")
    _daily(spark, d).write.partitionBy(DAY).parquet(features)
    table = spark.read.parquet(features)
    first = table.agg(F.min(DAY)).first()[0]
    last = table.agg(F.max(DAY)).first()[0]
    days = [first + dt.timedelta(days=n) for n in (9, 12, 13, 14, 24, 25)]
    out = steps.run_days(table, live.work_folder(spark, "steps"), [x for x in days if x < last] + [last])
    return _result_table(out)


@query
def upserted_days(spark, d):
    """Feature days written by several jobs: two that overlap, one that states a day completely, a withdrawal, a
    compaction, and one that began before it and commits after it."""
    day, path = _daily(spark, d).select(*KD, "sad_ratio", "sfi"), live.work_folder(spark, "changes")
    at = lambda n: f"{n:020d}-x"
    changes.upsert(day, path, version=at(1))
    changes.upsert(day.filter(f"{KEY} % 2 = 0").withColumn("sad_ratio", F.lit(2.0)), path, version=at(3))
    changes.upsert(day.filter(f"{KEY} % 3 = 0").withColumn("sad_ratio", F.lit(3.0)), path, version=at(2))
    changes.upsert(day.filter(f"{DAY} = '2024-01-09' AND {KEY} % 5 <> 0").withColumn("sfi", F.lit(-1.0)), path,
                   whole=["2024-01-09"], version=at(5))
    changes.withdraw(day.filter(f"{KEY} % 7 = 0 AND {DAY} >= '2024-01-12'"), path, version=at(6))
    changes.compact(spark, path)
    changes.upsert(day.filter(f"{KEY} % 4 = 1 OR {KEY} % 7 = 0").withColumn("sad_ratio", F.lit(4.0)), path, version=at(4))
    return tidy(changes.current(spark, path, f"{DAY} BETWEEN '2024-01-05' AND '2024-01-15'"))


# ---- risk ----------------------------------------------------------------

@query
def risk_levels(spark, d):
    """Levels from cold-start results at the default limit."""
    return tidy(risk.judge(_cold(spark, d)).drop(*[f"z_{f}" for f in FEATURES]))


@query
def risk_levels_sensitive(spark, d):
    """Levels at 1 sigma, where all four occur, with the advice text."""
    df = risk.judge(_cold(spark, d, Settings(fallback_sigma=1.0))).withColumn(
        "recommendation", risk.recommendation(F.col("risk_level"), F.array().cast("array<string>"), F.col("judged_streak")))
    return tidy(df.drop(*[f"z_{f}" for f in FEATURES]))


@query
def risk_types(spark, d):
    return tidy(risk.risk_rows(_results(spark, d).filter("status = 'success'")))


@query
def risk_types_unsigned(spark, d):
    """Risk types from absolute residuals, as an option."""
    df = daily.daily_job(_daily(spark, d), SENSITIVE, signed=False)
    return tidy(risk.risk_rows(df.filter("status = 'success'")))


@query
def risk_contributions(spark, d):
    return tidy(risk.risk_contributions(_results(spark, d).filter("saved")))


ALERT_COLUMNS = [KEY, DAY, "risk_level", "alerted", "alert_level", "alert_label", "action", "recipients", "actions",
                 "in_report", "highlight", "message"]


@query
def alert_rows(spark, d):
    return tidy(daily.daily_alerts(_results(spark, d)).select(*ALERT_COLUMNS))


@query
def cold_start_alerts(spark, d):
    """Routing and messages for all levels, with one risk name on sad days."""
    df = risk.judge(_cold(spark, d, Settings(fallback_sigma=1.0)))
    names = F.when(F.col("z_sad_ratio") > 1, F.array(F.lit(RISK_RULES[0].name))).otherwise(F.array().cast("array<string>"))
    return tidy(alerts.with_alert(df.withColumn("risk_types", names)).select(*ALERT_COLUMNS))


@query
def acute_levels(spark, d):
    u = _utterances(spark, d)
    df = handoff.with_ties_in_order(handoff.trailing_features(u, digits=False), u, risk.ACUTE_LIMITS)
    return tidy(df.select(KEY, "ts", risk.acute_level("demo").alias("demo_level"),
                          risk.acute_level("simple").alias("simple_level"),
                          risk.acute_level("config").alias("config_level")))


# ---- reports -------------------------------------------------------------

def _summary(spark, d):
    day = _daily(spark, d)
    return report.weekly_summary(daily.daily_job(day, SENSITIVE), SENSITIVE,
                                 week_end=day.agg(F.max(DAY)).scalar())


@query
def weekly_summary(spark, d):
    return tidy(_summary(spark, d))


@query
def weekly_text(spark, d):
    return tidy(_summary(spark, d).select(KEY, "week_end", report.rule_based_text().alias("body")))


@query
def weekly_prompts(spark, d):
    return tidy(report.weekly_prompts(_summary(spark, d)))


@query
def weekly_reports(spark, d):
    df = report.markdown_report(_summary(spark, d), GENERATED_AT)
    return tidy(df.withColumn("risk_label", report.risk_label_of("report")))


# ---- dialogue ------------------------------------------------------------

def _recognized(spark, d):
    """Documents as recognizer output: lines are segments, every fifth has no segments."""
    lines = F.split("text", "\n")
    tags = F.array(*[F.lit(t) for t in ["<|HAPPY|>", "<|SAD|>", "<|ANGRY|>", "", "<|FEARFUL|><|SAD|>", "<b>", "<|SURPRISED|>"]])
    seg = F.transform(lines, lambda x, i: F.struct(
        (i * 1500).cast("long").alias("start"), (i * 1500 + F.length(x) * 10).cast("long").alias("end"),
        F.pmod(F.length(x) + i, F.lit(3)).cast("int").alias("spk"),
        F.concat(F.element_at(tags, F.pmod(F.length(x), F.lit(7)) + 1), x).alias("sentence")))
    return ev.table(spark, d, "documents").select(
        "doc_id", "text", F.when(F.col("doc_id") % 5 != 0, seg).alias("sentence_info"))


@query
def recognized_utterances(spark, d):
    seg = dialogue.segments_of(_recognized(spark, d), ["doc_id"])
    return tidy(dialogue.utterances_of(seg, ["doc_id"], digits=False))


@query
def recognized_turns(spark, d):
    """Turns of named speakers in recognizer output."""
    seg = dialogue.segments_of(_recognized(spark, d), ["doc_id"])
    utt = dialogue.utterances_of(seg, ["doc_id"], digits=False)
    utt = utt.select("doc_id", "pos", "speaker", "text", F.round(F.col("start_sec") * 1000).cast("long").alias("start_ms"),
                     F.round(F.col("end_sec") * 1000).cast("long").alias("end_ms"))
    return tidy(dialogue.turns(utt, ["doc_id"], ["pos"]))


@query
def speaker_turns(spark, d):
    """Event types as speakers of one person's day."""
    e = _events(spark, d)
    midnight = F.unix_micros(F.col(DAY).cast("timestamp"))
    ms = F.floor((F.unix_micros("ts") - midnight) / 1000).cast("long")
    rows = e.select(*KD, *ARRIVAL, F.col("event_type").alias("speaker"), F.col("k").cast("int").cast("string").alias("text"),
                    ms.alias("start_ms"), (ms + F.floor(F.col("value") * 100).cast("long")).alias("end_ms"))
    return tidy(dialogue.turns(rows, KD, ARRIVAL, sep="|").drop("first_ts"))


@query
def speaker_names(spark, d):
    e = _events(spark, d).select(*KD, *ARRIVAL, "event_type")
    return tidy(dialogue.name_speakers(e, KD, "event_type", ARRIVAL).select(*KD, "event_id", "speaker"))


@query
def conversation_turns(spark, d):
    """Conversations with system messages counted to the user."""
    c = ev.table(spark, d, "conversations").select(
        "conv_id", "turn", F.when(F.col("role") == "system", "user").otherwise(F.col("role")).alias("speaker"),
        dialogue.strip_tags("text").alias("text"), (F.col("turn") * 1000).alias("start_ms"),
        (F.col("turn") * 1000 + 999).alias("end_ms"))
    return tidy(dialogue.turns(c, ["conv_id"], ["turn"], sep="\n"))


@query
def page_text(spark, d):
    """Tag-free page text, its length and its speech rate over a fixed pace."""
    p = ev.table(spark, d, "pages").select("page_id", dialogue.strip_tags("html").alias("text"), "html")
    return tidy(p.select("page_id", "text", dialogue.emotion_of("html").alias("emotion"), F.length("text").alias("n_chars"),
                         dialogue.speech_rate(F.col("text"), F.length("html") / 40.0).alias("speech_rate")))


# ---- trailing windows and hand-off --------------------------------------

@query
def trailing_24h(spark, d):
    return tidy(handoff.trailing_features(_utterances(spark, d), 24, digits=False))


@query
def trailing_4h(spark, d):
    return tidy(handoff.trailing_features(_utterances(spark, d), 4, digits=False))


@query
def trailing_1h(spark, d):
    return tidy(handoff.trailing_features(_utterances(spark, d), 1, digits=False))


def _snapshots(spark, d):
    return handoff.day_snapshots(handoff.trailing_features(_utterances(spark, d), 24, digits=False))


@query
def day_snapshots(spark, d):
    return tidy(_snapshots(spark, d))


@query
def acoustic_history(spark, d):
    """Seven days up to each person's last day, gaps filled with constants."""
    last = _utterances(spark, d).groupBy(KEY).agg(F.max(DAY).alias(DAY))
    return tidy(handoff.acoustic_history(last, _snapshots(spark, d)))


@query
def daily_packages(spark, d):
    """Live values on the last day, snapshots before it, constants in the gaps."""
    u = _utterances(spark, d)
    today = u.agg(F.max(DAY)).scalar()
    wanted = quality.calendar_spine(u.select(*KD).distinct()).select(*KD)
    live_now = acoustic.stream_features(u.filter(F.col(DAY) == today), [KEY], digits=False)
    return tidy(handoff.resolve_acoustic(wanted, _snapshots(spark, d), live_now, today))


@query
def sliding_24h(spark, d):
    return tidy(live.sliding_features(_utterances(spark, d), digits=False))


@query
def sliding_4h(spark, d):
    return tidy(live.sliding_features(_utterances(spark, d), "4 hours", "30 minutes", digits=False))


@query
def front_end_counters(spark, d):
    """Each event as a chunk with one utterance, or two if it is long."""
    one = F.struct(F.col("duration_sec"))
    chunks = _utterances(spark, d).select(KEY, F.when(F.col("duration_sec") > 5, F.array(
        one, F.struct((F.col("duration_sec") / 2).alias("duration_sec")))).otherwise(F.array(one)).alias("utterances"))
    return tidy(live.counters(chunks))


# ---- metrics -------------------------------------------------------------

def _truth(spark, d):
    return ev.table(spark, d, "labels").select("doc_id", (F.col("toxic") == 1).alias("actual"),
                                               (F.col("quality") == 0).alias("predicted"))


@query
def detection_metrics(spark, d):
    return tidy(metrics.detection_metrics(_truth(spark, d)))


@query
def detection_metrics_by_language(spark, d):
    docs = ev.table(spark, d, "documents").select("doc_id", "lang")
    return tidy(metrics.detection_metrics(_truth(spark, d).join(docs, "doc_id"), ["lang"]))


@query
def false_positive_rate(spark, d):
    docs = ev.table(spark, d, "documents").select("doc_id", "source")
    return tidy(metrics.false_positive_rate(_truth(spark, d).join(docs, "doc_id"), ["source"]))


@query
def truth_pairing(spark, d):
    """Labels against documents: keys found on one side only."""
    t = _truth(spark, d).select("doc_id", "actual")
    p = ev.table(spark, d, "documents").select("doc_id", (F.col("n_chars") > 1000).alias("predicted"))
    return tidy(metrics.orphans(metrics.pair(t, p, ["doc_id"])))


def _event_days(spark, d):
    """Truth of a person's day: more than a third of the speech is sad."""
    return _daily(spark, d).select(*KD, (F.col("sad_ratio") > 0.35).alias("actual"))


@query
def threshold_comparison(spark, d):
    """Personal score against one limit for everyone, both at 1.0."""
    score = _cold(spark, d)
    population = _daily(spark, d).select(*KD, (F.col("distress_events") / 3.0).alias("population"))
    df = score.select(*KD, F.col("anomaly_score").alias("personal")).join(population, KD).join(_event_days(spark, d), KD)
    return tidy(metrics.compare_thresholds(df, "personal", "population"))


@query
def early_warning(spark, d):
    """First warning of each person against their last sad day."""
    warn = _cold(spark, d, Settings(fallback_sigma=1.5)).filter("is_deviation").groupBy(KEY).agg(
        F.min(DAY).alias("warning_date"))
    event = _event_days(spark, d).filter("actual").groupBy(KEY).agg(F.max(DAY).alias("event_date"))
    return tidy(metrics.early_warning_days(event.join(warn, KEY)))


@query
def alert_rate(spark, d):
    df = risk.judge(_cold(spark, d, Settings(fallback_sigma=1.0)))
    people = _events(spark, d).select(KEY).distinct()
    return tidy(metrics.alert_rate(df, people, "2024-01-08", "2024-01-28", 2))


# ---- streams -------------------------------------------------------------

def _stream(spark, d):
    return ev.utterances(ev.event_stream(spark, d))


@query
def stream_sliding_24h(spark, d):
    """The sliding windows that the watermark has closed."""
    with stateful.rocksdb_store(spark):
        return tidy(live.run_available(live.sliding_features(_stream(spark, d), digits=False), "sliding"))


@query
def stream_trailing_24h(spark, d):
    """Exact trailing features at each arrival from keyed state, and an empty row where a day of silence has passed."""
    with stateful.rocksdb_store(spark):
        return tidy(live.run_available(stateful.trailing_features(_stream(spark, d), digits=False), "trailing"))


def _files_in_order(spark, d, files: int = 5) -> str:
    """The event table as ``files`` files of equal spans of time, written one after the other."""
    e, folder = ev.table(spark, d, "events"), live.work_folder(spark, "events")
    low, high = e.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))), F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()
    part = F.least(F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - low) * files / (high - low + 1)), F.lit(files - 1))
    for n in range(files):
        e.filter(part == n).coalesce(1).write.mode("append").parquet(folder)
    return folder


def _arrivals(spark, folder):
    schema = spark.read.parquet(folder).schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return ev.utterances(ev.with_event_columns(raw))


@query
def stream_trailing_multi(spark, d):
    """Horizons of 24, 4 and 1 hours from one state over five files, one a trigger, with the rows of expired windows."""
    with stateful.rocksdb_store(spark):
        out = stateful.trailing_horizons(_arrivals(spark, _files_in_order(spark, d)), (24, 4, 1), digits=False)
        return tidy(live.run_available(out, "horizons"))


@query
def stream_late_rows(spark, d):
    """Every sixth event comes with the file after its own: on time and late rows, counted per person."""
    e, folder, out = ev.table(spark, d, "events"), live.work_folder(spark, "events"), live.work_folder(spark, "split")
    part = F.floor(F.dayofmonth("ts") / 8) + (F.col("event_id") % 6 == 0).cast("int")
    for n in range(5):
        e.filter(part == n).coalesce(1).write.mode("append").parquet(folder)
    query = live.split_late(_arrivals(spark, folder), out, f"{out}/state", availableNow=True)
    query.awaitTermination()
    both = spark.read.parquet(f"{out}/on_time").withColumn("late", F.lit(False)).unionByName(
        spark.read.parquet(f"{out}/late").withColumn("late", F.lit(True)))
    return tidy(both.groupBy(KEY).agg(F.count_if(~F.col("late")).alias("on_time"), F.count_if("late").alias("late"),
                                      F.max(F.when(F.col("late"), F.col("ts"))).alias("last_late")))


@query
def stream_ewma(spark, d):
    """Running EWMA over a stream of daily scores."""
    folder = live.work_folder(spark, "scores")
    _cold(spark, d).select(*KD, "anomaly_score", F.lit(1.5).alias("static_threshold")).write.parquet(folder)
    scores = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
    with stateful.rocksdb_store(spark):
        return tidy(live.run_available(stateful.running_ewma(scores), "ewma"))
