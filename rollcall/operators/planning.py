"""Recommendations, projected impact of interventions, budget mixes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions.scalar import gender_risk_level
from rollcall.operators.ordering import top_k_per_group

# Recommendation per driver word, first match wins.
DRIVER_ACTIONS = (
    ("literacy", "language-literacy-campaign"),
    ("mobile", "digital-literacy-workshop"),
    ("bank", "bank-account-drive"),
    ("gap|gender", "women-only-registration-camp"),
)
DEFAULT_ACTION = "mobile-outreach"


def _collect(*rules: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in rules]))


def gender_actions(df: DataFrame) -> DataFrame:
    """Ordered actions for a district from its female ratio and size."""
    level = gender_risk_level(F.col("female_ratio"))
    always = F.lit(True)
    return df.withColumn("actions", _collect(
        (level.isin("CRITICAL", "HIGH"), "WOMEN_ONLY_CAMP"), ((F.col("total") < 10000) | (level != "LOW"), "MOBILE_VAN"),
        (always, "AWARENESS"), (level != "LOW", "SHG_PARTNERSHIP"), (always, "LANGUAGE_SUPPORT")))


# Actions per group whose status is LOW.
GROUP_ACTIONS = {"children": ("ANGANWADI_PARTNERSHIP",), "elderly": ("DOORSTEP_SERVICE", "PENSION_LINKAGE"),
                 "disabled": ("ACCESSIBILITY", "SPECIAL_CAMP")}


def group_actions(v: DataFrame, keys: Sequence[str], status: str = "LOW") -> DataFrame:
    """Actions per key from the statuses of its groups (one row per key and group in)."""
    g = v.filter((F.col("status") == status) & F.col("grp").isin(*GROUP_ACTIONS))
    g = g.groupBy(*keys).agg(F.collect_set("grp").alias("_g"))
    parts = [F.when(F.array_contains("_g", n), F.array(*[F.lit(a) for a in acts])).otherwise(F.array().cast("array<string>"))
             for n, acts in GROUP_ACTIONS.items()]
    return g.withColumn("actions", F.concat(*parts)).drop("_g")


def driver_action(drivers: Column, gender_gap: Column) -> Column:
    """Action for the first driver word found, else by gender gap, else the default."""
    out = None
    for pattern, action in DRIVER_ACTIONS:
        hit = F.exists(drivers, lambda f: F.lower(f).rlike(pattern))  # noqa: B023
        out = F.when(hit, action) if out is None else out.when(hit, action)
    return out.when(gender_gap > 0.1, DRIVER_ACTIONS[-1][1]).otherwise(DEFAULT_ACTION)


def programme_actions(regions: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """Programmes with the number of regions behind each and the five riskiest names."""
    rules = F.array_compact(F.array(
        F.when(F.col("risk_level") == "Critical", F.lit("1|Deploy Emergency Re-enrollment Camps")),
        F.when(F.array_contains("factors", "High elderly population"), F.lit("2|Senior Citizen Outreach Program")),
        F.when(F.array_contains("factors", "Low biometric update rate"), F.lit("3|Increase Update Center Capacity"))))
    one = regions.select("state", "risk_score", F.explode(rules).alias("_p"))
    counts = one.groupBy("_p").agg(F.count(F.lit(1)).alias("regions"))
    worst = top_k_per_group(one, ["_p"], [F.desc("risk_score"), F.asc("state")], 5)
    names = worst.groupBy("_p").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "state"))), lambda s: s["state"]), "|").alias("names"))
    out = counts.join(names, "_p").select(F.split("_p", "\\|")[0].cast("int").alias("priority"), F.split("_p", "\\|")[1].alias("title"), "regions", "names")
    if clusters is not None:
        hot = clusters.filter(F.col("mean_risk") >= 0.6).agg(F.count(F.lit(1)).alias("regions"), F.array_join(F.array_sort(F.collect_list(F.col("cluster").cast("string"))), "|").alias("names"))
        out = out.unionByName(hot.filter("regions > 0").select(F.lit(4).alias("priority"), F.lit("Demographic-Specific Programs").alias("title"), "regions", "names"))
    return out


# Unit cost, people reached per unit, success rate.
UNIT_RATES = {"CAMP": (25000, 500, 0.85), "MOBILE_VAN": (15000, 100, 0.90), "DOORSTEP": (500, 5, 0.95),
              "AWARENESS_CAMPAIGN": (50000, 5000, 0.15)}

# Fixed values: (share of new enrolments in percent, value per year) per benefit and target group.
BENEFITS = {"WOMEN": ((70, 6000), (90, 10000), (85, 0), (75, 14400)), "ELDERLY": ((80, 12000),), "CHILDREN": ((60, 2000),)}
BENEFITS["ALL"] = tuple(b for g in ("WOMEN", "ELDERLY", "CHILDREN") for b in BENEFITS[g])


def intervention_projection(df: DataFrame, scenarios: Sequence[dict]) -> DataFrame:
    """Reach, enrolments, cost, yearly value, gap change, ROI and break-even per district and scenario.

    A scenario has ``name``, ``kind``, ``quantity``, ``days`` and ``target``.
    Everything that does not depend on the district is a literal of the scenario.
    """
    rows = []
    for s in scenarios:
        cost, reach, rate = UNIT_RATES[s["kind"]]
        units = s["quantity"] * (s["days"] if s["kind"] == "MOBILE_VAN" else 1)
        total_reach, total_cost = reach * units, cost * units
        new = int(total_reach * rate + 0.5)
        value = sum(per * ((new * share + 50) // 100) for share, per in BENEFITS[s["target"]])
        rows.append(F.struct(F.lit(s["name"]).alias("scenario"), F.lit(s["target"]).alias("target"), F.lit(total_reach).cast("bigint").alias("reach"),
                             F.lit(new).cast("bigint").alias("new_enrolments"), F.lit(total_cost).cast("bigint").alias("cost"),
                             F.lit(value).cast("bigint").alias("annual_value")))
    out = df.withColumn("_s", F.explode(F.array(*rows))).select(*df.columns, "_s.*")
    now = F.col("female") / (F.col("female") + F.col("male"))
    then = (F.col("female") + F.col("new_enrolments")) / (F.col("female") + F.col("new_enrolments") + F.col("male"))
    roi = (F.col("annual_value") - F.col("cost")) * 100.0 / F.col("cost")
    out = out.withColumn("ratio_change", F.when(F.col("target") == "WOMEN", then - now)).withColumn("roi_pct", roi)
    return (out.withColumn("break_even_months", F.ceil(F.col("cost") / F.nullif(F.col("annual_value") / 12.0, F.lit(0.0))))
               .withColumn("advice", F.when(F.col("roi_pct") > 100, "HIGHLY RECOMMENDED").when(F.col("roi_pct") > 50, "RECOMMENDED").otherwise("CONSIDER ALTERNATIVES")))


def budget_plan(df: DataFrame, budget: str, target: int) -> DataFrame:
    """Camps, vans, or both for a budget; ranked by projected enrolments."""
    b = F.col(budget)
    van = lambda x: F.floor(x / 75000) * 5
    mixes = F.array(*[F.struct(F.lit(n).alias("mix"), F.lit(i).alias("_o"), c.cast("bigint").alias("camps"), v.cast("bigint").alias("van_days")) for i, (n, c, v) in enumerate((
        ("Camps Only", F.floor(b / 25000), F.lit(0)), ("Mobile Vans Only", F.lit(0), van(b)), ("Mixed Strategy", F.floor(b * 6 / 250000), van(b * 4 / 10))))])
    out = df.withColumn("_m", F.explode(mixes)).select(*df.columns, "_m.*")
    out = out.withColumn("cost", F.col("camps") * 25000 + F.col("van_days") * 15000).withColumn("projected", F.col("camps") * 425 + F.col("van_days") * 90)
    out = out.withColumn("meets_target", F.col("projected") >= target)
    best = out.groupBy(*df.columns).agg(F.min_by("mix", F.struct((-F.col("projected")).alias("p"), "_o")).alias("best"))
    return out.join(best, df.columns).drop("_o")
