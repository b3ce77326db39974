"""Max-interval bursts as gaps and islands, and burst statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spikeloom.operators.ordered import in_order, run_number
from spikeloom.operators.skew import attach, hot_counts, salted_join
from spikeloom.operators.spikes import UNIT
from spikeloom.operators.units import adaptation, intervals
from spikeloom.session import checkpoint

TIE = ["spike_id"]


@dataclass(frozen=True)
class BurstRule:
    """Thresholds in the unit of ``t``; None derives them from the unit's mean interval."""

    min_count: int = 5
    min_dur: float = 0
    max_start: float | None = None
    max_end: float | None = None
    max_int: float | None = None
    drop_lone_last: bool = True

    def __post_init__(self):
        if self.max_start is not None and self.max_end is not None and self.max_start > self.max_end:
            raise ValueError("max_start must not exceed max_end")


def _limits(spikes: DataFrame, rule: BurstRule) -> DataFrame:
    """Spikes with the thresholds of their unit; only missing thresholds need a pass over the data."""
    lit = lambda v: F.lit(float(v))
    mean = F.col("_mean")
    start = mean / 2 if rule.max_start is None else lit(rule.max_start)
    end = mean if rule.max_end is None else lit(rule.max_end)
    gap = end if rule.max_int is None else lit(rule.max_int)
    d = spikes.select(*UNIT, "spike_id", "t")
    if rule.max_start is None or rule.max_end is None:
        per = d.groupBy(*UNIT).agg(F.try_divide(F.max("t") - F.min("t"), F.count(F.lit(1)) - 1).alias("_mean"))
        d = attach(d, per, UNIT, F.col("spike_id"))
    return d.select(*UNIT, "spike_id", "t", start.alias("_start"), end.alias("_end"), gap.alias("_gap"))


def _in_runs(spikes: DataFrame, rule: BurstRule, length: int) -> DataFrame:
    """Spikes numbered by run; a run breaks where the interval exceeds max_end."""
    starts = F.col("_pt").isNull() | (F.col("t") - F.col("_pt") > F.col("_end"))
    d = in_order(
        _limits(spikes, rule), UNIT, "t", length, tie=TIE, lag={"_pt": "t"}, lead={"_nt": "t"}, index="pos",
        total="_n", running={"run": run_number(starts)},
    ).where((F.col("_n") >= rule.min_count) & (F.col("_n") > 1))
    opens = (F.col("_nt") - F.col("t") <= F.col("_start")) & (F.col("pos") < F.col("_n") - rule.min_count)
    return d.withColumn("opens", F.coalesce(opens, F.lit(False)))


def raw_bursts(spikes: DataFrame, rule: BurstRule, length: int) -> DataFrame:
    """Bursts before merging: from the first opening spike of a run to its end."""
    d = _in_runs(spikes, rule, length)
    first = F.min(F.when(F.col("opens"), F.col("pos")))
    return (
        d.groupBy(*UNIT, "run")
        .agg(
            first.alias("first_pos"),
            F.max("pos").alias("last_pos"),
            F.min(F.when(F.col("opens"), F.col("t"))).alias("start_t"),
            F.max("t").alias("end_t"),
            F.first("_gap").alias("_gap"),
        )
        .where(F.col("first_pos").isNotNull())
        .withColumn("n_spikes", F.col("last_pos") - F.col("first_pos") + 1)
    )


def _grouped(raw: DataFrame, rule: BurstRule, length: int) -> DataFrame:
    """Raw bursts numbered by the merged burst they belong to."""
    starts = F.col("_pe").isNull() | (F.col("start_t") - F.col("_pe") >= F.col("_gap"))
    return in_order(
        raw, UNIT, "start_t", length, lag={"_pe": "end_t"}, lead={"_ns": "start_t"}, total="_raw",
        running={"burst": run_number(starts)},
    )


def _kept(grouped: DataFrame, rule: BurstRule) -> DataFrame:
    b = grouped.groupBy(*UNIT, "burst").agg(
        F.min("start_t").alias("start_t"),
        F.max("end_t").alias("end_t"),
        F.sum("n_spikes").alias("n_spikes"),
        F.count(F.lit(1)).alias("n_raw"),
        F.first("_raw").alias("_raw"),
        F.bool_or(F.col("_ns").isNull()).alias("_last"),
    )
    if rule.drop_lone_last:
        b = b.where(~(F.col("_last") & (F.col("n_raw") == 1) & (F.col("_raw") > 1)))
    b = b.drop("_last", "_raw")
    return b.where((F.col("end_t") - F.col("start_t") >= rule.min_dur) & (F.col("n_spikes") >= rule.min_count))


def bursts(spikes: DataFrame, rule: BurstRule, length: int) -> DataFrame:
    """Merged and filtered bursts.

    With ``drop_lone_last`` a last burst that merged with no other is left out when the
    unit has several raw bursts.
    """
    return _kept(_grouped(raw_bursts(spikes, rule, length), rule, length), rule)


def burst_spikes(spikes: DataFrame, rule: BurstRule, length: int) -> DataFrame:
    """The spikes of each kept burst, with the number of the burst.

    The burst-level table is checkpointed: three branches read it.
    """
    runs = _in_runs(spikes, rule, length).select(*UNIT, "spike_id", "t", "pos", "run")
    g = checkpoint(_grouped(raw_bursts(spikes, rule, length), rule, length))
    kept = _kept(g, rule).select(*UNIT, "burst")
    members = g.select(*UNIT, "run", "first_pos", "burst").join(kept, [*UNIT, "burst"], "left_semi")
    hot = hot_counts(g.select(*UNIT, "run", F.col("n_spikes").alias("_n")), [*UNIT, "run"])
    return salted_join(runs, members, [*UNIT, "run"], F.col("spike_id"), hot=hot).where("pos >= first_pos").select(*UNIT, "burst", "spike_id", "t")


def burst_properties(spikes: DataFrame, rule: BurstRule, refractory: float, length: int) -> DataFrame:
    """One row per burst: interval, size, adaptation measures and length."""
    keys = [*UNIT, "burst"]
    iv = intervals(burst_spikes(spikes, rule, length), length, keys)
    return adaptation(iv, keys, refractory).select(
        *keys,
        F.col("mean_isi").alias("intra_burst_iei"),
        F.col("n_spikes").alias("spikes_per_burst"),
        "local_sfa",
        "rlocal_sfa",
        "divisor_sfa",
        "abi_sfa",
        (F.col("last_t") - F.col("first_t")).alias("burst_len"),
        F.col("first_t").alias("start_t"),
        F.col("last_t").alias("end_t"),
    )


def inter_burst_intervals(b: DataFrame, length: int) -> DataFrame:
    """Gap from each burst to the next; null on the last."""
    d = in_order(b, UNIT, "start_t", length, lead={"_ns": "start_t"})
    return d.withColumn("inter_burst_iei", F.col("_ns") - F.col("end_t")).drop("_ns")


def histogram_mode(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Left edge of the fullest of n//4 equal bins; the mean when that is four bins or fewer."""
    lim = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.avg(value).alias("_m")
    )
    lim = lim.withColumn("_bins", F.when(F.col("_n") > 4, F.expr("_n div 4")).otherwise(F.col("_n")))
    width = (F.col("_hi") - F.col("_lo")) / F.col("_bins")
    b = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("_lo")) / width), F.col("_bins") - 1)).otherwise(0)
    counts = (
        df.where(F.col(value).isNotNull())
        .join(lim.where("_bins > 4"), keys)
        .groupBy(*keys, b.alias("_b"), width.alias("_w"), "_lo")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    top = counts.groupBy(*keys).agg(
        F.max_by(F.col("_lo") + F.col("_b") * F.col("_w"), F.struct(F.col("_c"), -F.col("_b"))).alias("_mode")
    )
    return lim.join(top, keys, "left").select(
        *keys, F.when(F.col("_bins") > 4, F.col("_mode")).otherwise(F.col("_m")).alias(f"peak_{value}")
    )


def burst_unit_means(props: DataFrame, length: int) -> DataFrame:
    """Per-unit means over bursts, with modes for the adaptation measures."""
    props = checkpoint(props)
    cols = ["intra_burst_iei", "spikes_per_burst", "local_sfa", "rlocal_sfa", "divisor_sfa", "abi_sfa", "burst_len"]
    out = inter_burst_intervals(props, length).groupBy(*UNIT).agg(
        F.count(F.lit(1)).alias("num_bursts"),
        F.sum("burst_len").alias("total_burst_time"),
        F.avg("inter_burst_iei").alias("inter_burst_iei"),
        *[F.avg(c).alias(c) for c in cols],
    )
    sfa = [c for c in cols if "sfa" in c]
    long = props.unpivot(UNIT, sfa, "measure", "value")
    modes = histogram_mode(long, [*UNIT, "measure"], "value").groupBy(*UNIT).agg(
        *[F.max(F.when(F.col("measure") == c, F.col("peak_value"))).alias(f"peak_{c}") for c in sfa]
    )
    return out.join(modes, UNIT, "left")
