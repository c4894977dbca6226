"""Process capability: rankings, fleet capability, yield, stability, charts on subgroups."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import capability_class, confidence_label, last, last_of_data, max_abs, pct, range_abs, rnd, row_mean, ts_lit
from ..functions.predicates import in_or_all
from ..schema import JE_COLS, PE_COLS
from .aggregates import exact_percentiles
from .joins import full_outer_coalesce, registry_left

# A setting at or below this is a placeholder, and the tolerance assumed where none is set.
NO_RECIPE_SETTING = 2.0
DEFAULT_SETTING = 25.0

SURFACE_KEYS = ["eqp_id", "factory", "mo", "fpn", "layer_name"]


def unpivot_samples(df: DataFrame, cols: list[str], keep: list[str], out: str = "sample") -> DataFrame:
    """One row per present reading of the repeated columns."""
    exploded = df.select(*keep, F.explode(F.array(*cols)).alias(out))
    return exploded.where(F.col(out).isNotNull())


def _samples(tele: DataFrame, cols: list[str], setting: str, keys: list[str]) -> DataFrame:
    base = tele.where(F.col(cols[0]).isNotNull() & (F.coalesce(F.col(setting), F.lit(0.0)) > NO_RECIPE_SETTING))
    base = base.withColumn("_limit", F.coalesce(F.col(setting), F.lit(DEFAULT_SETTING)).cast("double"))
    return unpivot_samples(base, cols, [*keys, "_limit"])


def _stats(samples: DataFrame, keys: list[str]) -> DataFrame:
    return samples.groupBy(*keys).agg(
        F.count("sample").alias("n"),
        F.count_if(F.abs("sample") <= F.col("_limit")).alias("passed"),
        F.avg("sample").alias("mu"),
        F.stddev_samp("sample").alias("sigma"),
        F.avg("_limit").alias("setting"),
    )


def _capability(mu: Column, sigma: Column, setting: Column) -> tuple[Column, Column]:
    spread = F.nullif(3 * sigma, F.lit(0.0))
    return setting / spread, F.least((setting - mu) / spread, (mu + setting) / spread)


def _capability_table(tele: DataFrame, cols: list[str], setting: str, keys: list[str], suffix: str) -> DataFrame:
    stats = _stats(_samples(tele, cols, setting, keys), keys)
    cp, cpk = _capability(F.col("mu"), F.col("sigma"), F.col("setting"))
    return stats.select(
        *keys, *[F.col(c).alias(f"{c}{suffix}") for c in ("n", "passed", "mu", "sigma")],
        cp.alias(f"cp{suffix}"), cpk.alias(f"cpk{suffix}"),
    )


def spc_ranking(tele: DataFrame, hours: int | None = 2, pe: list[str] = PE_COLS, je: list[str] = JE_COLS) -> DataFrame:
    """Capability per machine and job from the last hours of data; PE-only, JE-only and both all surface."""
    recent = tele if hours is None else last_of_data(tele, "time", f"{hours} hours")
    p = _capability_table(recent, pe, "pe_setting", SURFACE_KEYS, "_p")
    j = _capability_table(recent, je, "je_setting", SURFACE_KEYS, "_j")
    both = full_outer_coalesce(p, j, SURFACE_KEYS).where(F.coalesce("sigma_p", "sigma_j") > 0)

    def side(s: str, label: str) -> list[Column]:
        return [
            F.col(f"n{s}").alias(f"sample_count{label}"),
            rnd(f"mu{s}", 3).alias(f"mean_{'je' if label else 'pe'}"),
            rnd(f"sigma{s}", 3).alias(f"stddev_{'je' if label else 'pe'}"),
            rnd(f"cp{s}", 3).alias(f"cp{label}"),
            rnd(f"cpk{s}", 3).alias(f"cpk{label}"),
            capability_class(F.col(f"cpk{s}")).alias(f"capability_class{label}"),
        ]

    ranked = both.select(*SURFACE_KEYS, *side("_p", ""), *side("_j", "_je"))
    return ranked.orderBy(F.desc_nulls_last("cpk"), *SURFACE_KEYS)


def spc_fleet(tele: DataFrame, devices: DataFrame, as_of: datetime | str, hours: int = 24, device_type: str = "ldi") -> DataFrame:
    """Capability and pass rates of every enabled registered machine, silent ones included."""
    recent = last(tele, "time", f"{hours} hours", as_of)
    p = _capability_table(recent, PE_COLS, "pe_setting", ["eqp_id"], "_pe")
    j = _capability_table(recent, JE_COLS, "je_setting", ["eqp_id"], "_je")
    fleet = devices.where((F.col("device_type") == device_type) & F.col("enabled")).select(
        F.col("device_id").alias("eqp_id"), "location"
    )
    rows = registry_left(registry_left(fleet, p, "eqp_id"), j, "eqp_id")
    worst = F.least("cpk_pe", "cpk_je")
    worst_n = (
        F.when(F.col("cpk_pe").isNull(), F.col("n_je"))
        .when(F.col("cpk_je").isNull() | (F.col("cpk_pe") <= F.col("cpk_je")), F.col("n_pe"))
        .otherwise(F.col("n_je"))
    )
    return rows.select(
        "eqp_id", "location",
        "n_pe", rnd("cp_pe", 3).alias("cp_pe"), rnd("cpk_pe", 3).alias("cpk_pe"),
        rnd(pct("passed_pe", "n_pe"), 1).alias("pe_pass_rate"),
        "n_je", rnd("cp_je", 3).alias("cp_je"), rnd("cpk_je", 3).alias("cpk_je"),
        rnd(pct("passed_je", "n_je"), 1).alias("je_pass_rate"),
        rnd(worst, 3).alias("worst_cpk"), worst_n.alias("worst_n"),
    )


def cpk_confidence(fleet: DataFrame, min_n: int = 30) -> DataFrame:
    return fleet.withColumn("confidence", confidence_label(F.col("worst_cpk"), F.col("worst_n"), min_n))


def max_error_capability(tele: DataFrame, as_of: datetime | str, minutes: int = 60, pe: list[str] = PE_COLS) -> DataFrame:
    """Capability of the largest absolute error of each row, with sigma level and spec limits, per machine."""
    recent = last(tele, "time", f"{minutes} minutes", as_of, inclusive=True).where(F.col(pe[0]).isNotNull())
    stats = recent.groupBy("eqp_id").agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.avg(max_abs(pe)).alias("mu"),
        F.stddev_samp(max_abs(pe)).alias("sigma"),
        F.avg(F.coalesce(F.col("pe_setting").cast("double"), F.lit(DEFAULT_SETTING))).alias("setting"),
    ).where(F.col("sigma") > 0)
    cp, cpk = _capability(F.col("mu"), F.col("sigma"), F.col("setting"))
    return stats.select(
        "eqp_id", "sample_count", rnd("mu", 3).alias("mean_pe"), rnd("sigma", 3).alias("stddev_pe"),
        rnd(cp, 3).alias("cp"), rnd(cpk, 3).alias("cpk"), rnd(2 * cpk + 1.5, 2).alias("sigma_level"),
        rnd("setting", 1).alias("spec_upper"), rnd(-F.col("setting"), 1).alias("spec_lower"),
    )


def yield_pct(tele: DataFrame, since: datetime | str, until: datetime | str, machines: list[str] | None = None) -> DataFrame:
    """Worse of the PE and JE pass percentages over the period, from one pass."""
    rows = tele.where(F.col("time").between(ts_lit(since), ts_lit(until)) & in_or_all("eqp_id", machines))

    def rate(cols: list[str], setting: str) -> Column:
        passed = F.count_if(max_abs(cols, coalesce0=False) <= F.col(setting))
        measured = F.count_if(F.col(cols[0]).isNotNull())
        return rnd(passed * 100.0 / F.nullif(measured, F.lit(0)), 1)

    p, j = rate(PE_COLS, "pe_setting"), rate(JE_COLS, "je_setting")
    return rows.agg(p.alias("pe_yield"), j.alias("je_yield")).select(
        "pe_yield", "je_yield", F.least("pe_yield", "je_yield").alias("yield_pct")
    )


def process_stability(tele: DataFrame, hours: int | None = 2) -> DataFrame:
    """Temperature, humidity, PE and JE stability scores and their sum (which can exceed 100: 33+33+34+17)."""
    recent = tele if hours is None else last_of_data(tele, "time", f"{hours} hours")
    measured = F.col(PE_COLS[0]).isNotNull()
    pe, je = F.when(measured, max_abs(PE_COLS)), F.when(measured, max_abs(JE_COLS))
    stats = recent.groupBy("eqp_id").agg(
        F.count(F.coalesce(F.col("temperature"), F.col("humidity"), pe)).alias("_any"),
        F.stddev_samp("temperature").alias("t"), F.stddev_samp("humidity").alias("h"),
        F.stddev_samp(pe).alias("ps"), F.avg(pe).alias("pm"), F.stddev_samp(je).alias("js"), F.avg(je).alias("jm"),
    ).where(F.col("_any") > 0)

    def known(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(99.0))

    zero = F.lit(0.0)
    scores = {
        "temp_score": F.greatest(zero, 33 - known("t") * 10),
        "hum_score": F.greatest(zero, 33 - known("h") * 10),
        "pe_score": F.greatest(zero, 34 - known("ps") * 5 - known("pm") * 2),
        "je_score": F.greatest(zero, 17 - known("js") * 5 - known("jm")),
    }
    total = scores["temp_score"] + scores["hum_score"] + scores["pe_score"] + scores["je_score"]
    return stats.select("eqp_id", *[rnd(c, 1).alias(n) for n, c in scores.items()], rnd(total, 1).alias("stability_index"))


def capability_alert(ranking: DataFrame, cpk: float = 1.33, n: int = 30) -> DataFrame:
    """Machines whose PE or JE capability is below the limit on enough samples."""
    surfaces = [("PE", "cpk", "sample_count"), ("JE", "cpk_je", "sample_count_je")]
    rows = F.array(*[F.struct(F.lit(s).alias("surface"), F.col(c).alias("value"), F.col(m).alias("n")) for s, c, m in surfaces])
    return (
        ranking.select(*SURFACE_KEYS, F.explode(rows).alias("r"))
        .select(*SURFACE_KEYS, "r.*")
        .where((F.col("value") < cpk) & (F.col("n") >= n))
    )


def xbar_r(tele: DataFrame, samples: list[str] = PE_COLS) -> DataFrame:
    """X-bar and R chart: subgroup mean and range per row, limits from the machine's averages.

    The averages are aggregated per machine and joined back, so no machine is gathered in one place.
    """
    # Control chart factors A2, D3, D4 by subgroup size.
    factors = {2: (1.880, 0.0, 3.267), 3: (1.023, 0.0, 2.574), 4: (0.729, 0.0, 2.282), 5: (0.577, 0.0, 2.114), 6: (0.483, 0.0, 2.004)}
    a2, d3, d4 = factors[len(samples)]
    rows = tele.where(F.col(samples[0]).isNotNull()).select(
        "time", "eqp_id", "log_id", row_mean(samples).alias("xbar"), range_abs(samples).alias("r")
    )
    centre = rows.groupBy("eqp_id").agg(F.avg("xbar").alias("xx"), F.avg("r").alias("rr"))
    return rows.join(centre, "eqp_id").select(
        "time", "eqp_id", "log_id", rnd("xbar", 4).alias("xbar"), rnd("r", 4).alias("r"),
        rnd(F.col("xx") + a2 * F.col("rr"), 4).alias("x_ucl"), rnd(F.col("xx") - a2 * F.col("rr"), 4).alias("x_lcl"),
        rnd(d4 * F.col("rr"), 4).alias("r_ucl"), rnd(d3 * F.col("rr"), 4).alias("r_lcl"),
    )


def error_distribution(tele: DataFrame, samples: list[str] = PE_COLS) -> DataFrame:
    """Quartiles and spread of the samples per machine."""
    flat = unpivot_samples(tele, samples, ["eqp_id"])
    box = exact_percentiles(flat, ["eqp_id"], "sample", {"lo": 0.0, "q1": 0.25, "med": 0.5, "q3": 0.75, "hi": 1.0})
    sigma = flat.groupBy("eqp_id").agg(rnd(F.stddev_samp("sample"), 4).alias("sigma"))
    return box.select("eqp_id", "n", *[rnd(c, 4).alias(c) for c in ("lo", "q1", "med", "q3", "hi")]).join(sigma, "eqp_id")

