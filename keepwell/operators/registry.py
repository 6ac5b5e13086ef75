"""Champion / challenger decisions as data: replay, current roles, history.

A model line has two candidates.  Every event acts on "who is champion" in one
of three ways: it leaves it, it swaps it, or it sets it whatever it was.  So
the champion after an event is the value last set, swapped as often as swaps
came after it, which makes the replay a parallel scan instead of a walk
through each line's history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepwell import config as cfg
from keepwell.functions.ordered import RANGE

FIRST, SECOND = "logistic_regression", "gbt"
HISTORY = ["line", "seq", "action", "previous_champion", "new_champion", "champion_metric",
           "challenger_metric", "delta"]


def _passes(challenger_auc: Column, champion_auc: Column, challenger_recall: Column,
            threshold: Column) -> Column:
    return (challenger_auc - champion_auc >= threshold) & (challenger_recall >= cfg.MIN_RECALL)


def threshold_per_line(runs: DataFrame, settings: DataFrame | None) -> DataFrame:
    """Adds `threshold`: the latest stored one of the line, else the configured one."""
    default = F.lit(cfg.PROMOTION_THRESHOLD)
    if settings is None:
        return runs.withColumn("threshold", default)
    latest = settings.groupBy("line").agg(F.max_by("value", "seq").alias("_stored"))
    return runs.join(latest, "line", "left") \
        .withColumn("threshold", F.coalesce("_stored", default)).drop("_stored")


def replay(runs: DataFrame, settings: DataFrame | None = None) -> DataFrame:
    """History of every line: one row per event, in `seq` order.

    `runs`: line, seq, kind (train / rollback), lr_auc, lr_recall, gbt_auc,
    gbt_recall, and RANGE, a value range that follows `seq`.  A rollback before
    the first training changes nothing and is reported as 'rejected'.

    Rows are shuffled once, by (line, range).  Inside a range the state is
    known up to what it is entered with; one summary row per range carries
    that over from range to range.
    """
    src = threshold_per_line(runs, settings)
    is_train = F.col("kind") == "train"
    inside = Window.partitionBy("line", RANGE).orderBy("seq")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    ranges = Window.partitionBy("_line").orderBy("_range_no")
    earlier = ranges.rowsBetween(Window.unboundedPreceding, -1)
    same = (F.col("line") == F.col("_line")) & (F.col(RANGE) == F.col("_range_no"))

    def summary(df: DataFrame, *aggs: Column) -> DataFrame:
        return df.groupBy(F.col("line").alias("_line"), F.col(RANGE).alias("_range_no")).agg(*aggs)

    before = summary(runs, F.count_if(is_train).alias("_n")).select(
        "_line", "_range_no",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_trains_before"))
    counted = src.join(before, same, "left").drop("_line", "_range_no").withColumn(
        "_trains", F.col("_trains_before") + F.sum(is_train.cast("int")).over(upto))

    # Champion as a bit: 0 the first candidate, 1 the second.
    to_second = _passes(F.col("gbt_auc"), F.col("lr_auc"), F.col("gbt_recall"), F.col("threshold"))
    to_first = _passes(F.col("lr_auc"), F.col("gbt_auc"), F.col("lr_recall"), F.col("threshold"))
    initial = is_train & (F.col("_trains") == 1)
    sets = F.when(initial, F.when(F.col("lr_auc") >= F.col("gbt_auc"), 0).otherwise(1)) \
        .when(is_train & to_second & ~to_first, 1) \
        .when(is_train & to_first & ~to_second, 0)
    both = is_train & ~initial & to_first & to_second  # only with a threshold of 0 or less
    local = counted.withColumn("_sets", sets) \
        .withColumn("_swaps", F.sum(((~is_train) | both).cast("int")).over(upto)) \
        .withColumn("_base", F.last(_flip(F.col("_sets"), F.col("_swaps")), True).over(upto)) \
        .withColumn("_metrics", F.last(
            F.when(is_train, F.struct("lr_auc", "gbt_auc")), True).over(upto))

    ends = summary(
        local, F.max("_swaps").alias("_n"), F.max_by("_base", "seq").alias("_end_base"),
        F.max_by("_metrics", "seq").alias("_end_metrics"))
    so_far = F.sum("_n").over(ranges.rowsBetween(Window.unboundedPreceding, 0))
    ends = ends.withColumn("_upto", so_far) \
        .withColumn("_set", _flip(F.col("_end_base"), F.col("_upto") - F.col("_n")))
    enter = ends.select(
        "_line", "_range_no",
        _flip(F.last("_set", True).over(earlier), F.col("_upto") - F.col("_n")).alias("_enter"),
        F.last("_end_metrics", True).over(earlier).alias("_enter_metrics"))
    state = local.join(enter, same, "left") \
        .withColumn("_after", _flip(F.coalesce("_base", "_enter"), F.col("_swaps"))) \
        .withColumn("_latest", F.coalesce("_metrics", "_enter_metrics"))
    whole = state.withColumn("_before", F.when(
        F.row_number().over(inside) == 1, F.col("_enter")).otherwise(F.lag("_after").over(inside)))

    lr, gbt = F.col("_latest.lr_auc"), F.col("_latest.gbt_auc")
    started = F.col("_trains") > 0
    was, now = F.col("_before"), F.col("_after")
    # A training compares the champion it found with its challenger; the first
    # one, and a rollback, report the roles they leave.
    basis = F.when(initial | ~is_train, now).otherwise(was)
    champion_metric = F.when(basis == 0, lr).otherwise(gbt)
    challenger_metric = F.when(basis == 0, gbt).otherwise(lr)
    action = F.when(~started, "rejected").when(~is_train, "manual_rollback") \
        .when(initial, "initial").when(was != now, "promote").otherwise("retain")

    def name(bit: Column) -> Column:
        return F.when(bit == 0, FIRST).when(bit == 1, SECOND)

    return whole.select(
        "line", "seq", action.alias("action"),
        name(F.when(~initial, was)).alias("previous_champion"), name(now).alias("new_champion"),
        F.when(started, champion_metric).alias("champion_metric"),
        F.when(started, challenger_metric).alias("challenger_metric"),
        F.when(started, challenger_metric - champion_metric).alias("delta"), RANGE)


def _flip(bit: Column, times: Column) -> Column:
    """The bit after that many swaps."""
    return bit.bitwiseXOR((times % 2).cast("int"))


def promotion_decisions(runs: DataFrame, settings: DataFrame | None = None) -> DataFrame:
    """What each training would decide with the first candidate as champion."""
    src = threshold_per_line(runs.where("kind = 'train'"), settings)
    delta = F.col("gbt_auc") - F.col("lr_auc")
    promote = _passes(F.col("gbt_auc"), F.col("lr_auc"), F.col("gbt_recall"), F.col("threshold"))
    return src.select(
        "line", "seq", delta.alias("delta"), F.col("gbt_recall").alias("challenger_recall"),
        "threshold", F.when(promote, "promote").otherwise("retain").alias("action"))


def current_roles(history: DataFrame) -> DataFrame:
    """Champion, challenger and last change of each line: its latest accepted row."""
    latest = history.where("action <> 'rejected'").groupBy("line").agg(
        F.max_by(F.struct("seq", "action", "new_champion"), "seq").alias("last"))
    champion = F.col("last.new_champion")
    return latest.select(
        "line", champion.alias("champion"),
        F.when(champion == FIRST, SECOND).otherwise(FIRST).alias("challenger"),
        F.col("last.seq").alias("seq"), F.col("last.action").alias("last_action"))


def recent_promotions(history: DataFrame, n: int = 10) -> DataFrame:
    """The last n accepted entries of each line, oldest first.

    The rank limit applies on the map side, so a long history sends on n rows a task.
    """
    newest = F.row_number().over(Window.partitionBy("line").orderBy(F.desc("seq")))
    return history.where("action <> 'rejected'").withColumn("_n", newest) \
        .where(F.col("_n") <= n).drop("_n").orderBy("line", "seq").select(*HISTORY)


def status(history: DataFrame, settings: DataFrame | None = None) -> DataFrame:
    """Per line: roles, threshold in force, accepted entries, and the last ten actions, oldest first."""
    recent = recent_promotions(history).groupBy("line").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("seq", "action"))), lambda x: x["action"]), ",").alias("recent_actions"))
    counts = history.where("action <> 'rejected'").groupBy("line").agg(F.count(F.lit(1)).alias("n_entries"))
    return threshold_per_line(current_roles(history), settings).join(counts, "line").join(recent, "line")


def decide(champion: str | None, metrics: dict[str, dict[str, float]],
           threshold: float = cfg.PROMOTION_THRESHOLD) -> dict:
    """One decision for a training job, from its two candidates' metrics."""
    primary = cfg.PRIMARY_METRIC
    if champion is None:
        first = metrics[FIRST][primary] >= metrics[SECOND][primary]
        winner, loser = (FIRST, SECOND) if first else (SECOND, FIRST)
        return {"action": "initial", "previous_champion": None, "champion": winner,
                "challenger": loser, "champion_metric": metrics[winner][primary],
                "challenger_metric": metrics[loser][primary],
                "delta": metrics[loser][primary] - metrics[winner][primary]}
    rival = SECOND if champion == FIRST else FIRST
    delta = metrics[rival][primary] - metrics[champion][primary]
    promote = delta >= threshold and metrics[rival].get("recall", 0.0) >= cfg.MIN_RECALL
    return {"action": "promote" if promote else "retain", "previous_champion": champion,
            "champion": rival if promote else champion,
            "challenger": champion if promote else rival,
            "champion_metric": metrics[champion][primary],
            "challenger_metric": metrics[rival][primary], "delta": delta}
