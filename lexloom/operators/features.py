"""Features and labels of judges, as frames keyed by ``judge_id``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rulings import us_support
from ..functions.text import norm_string, to_list, to_long, to_time
from .relational import first_per

APPELLATE = "appeal|circuit"


def promotion_info(appointments: DataFrame) -> DataFrame:
    """District judges with ``is_promoted`` and ``promotion_date`` (earliest appellate nomination).

    One grouped pass over the appointments.
    """
    kind = F.lower("court_type")
    upper = kind.rlike(APPELLATE)
    per = appointments.groupBy("judge_id").agg(
        F.max(kind.contains("district").cast("int")).alias("district"), F.coalesce(F.max(upper.cast("int")), F.lit(0)).alias("is_promoted"), F.min(F.when(upper, to_time(F.col("nomination_date")))).alias("promotion_date")
    )
    return per.where("district = 1").drop("district")


def is_promoted(appointments: DataFrame) -> DataFrame:
    """``(judge_id, is_promoted)``: 1 for every judge with an appellate appointment."""
    return appointments.groupBy("judge_id").agg(F.coalesce(F.max(F.lower("court_type").rlike(APPELLATE).cast("int")), F.lit(0)).alias("is_promoted"))


def overturn_rate(judges: DataFrame, cases: DataFrame, months: int = 3) -> DataFrame:
    """``(judge_id, appealed, overturned, overturn_rate)`` of cases decided up to ``months`` before promotion.

    ``judges(judge_id, promotion_date)``, one row per judge; a null disposition counts as overturned.
    """
    j = judges.select(to_long(F.col("judge_id")).alias("judge_id"), F.expr(f"promotion_date - interval {int(months)} months").alias("cutoff"))
    c = cases.select(to_long(F.col("district_judge_id")).alias("judge_id"), to_time(F.col("decision_date")).alias("decision_date"), (F.coalesce(F.lower("opinion"), F.lit("")) != "affirmed").alias("over"), "unique_id")
    counted = c.join(j, "judge_id").where("decision_date is not null and (cutoff is null or decision_date <= cutoff)").groupBy("judge_id").agg(F.count("unique_id").alias("appealed"), F.count_if("over").alias("overturned"))
    out = j.select("judge_id").join(counted, "judge_id", "left").fillna(0, ["appealed", "overturned"])
    return out.withColumn("overturn_rate", F.when(F.col("appealed") > 0, F.col("overturned") / F.col("appealed")))


def us_support_rate(cases: DataFrame, key: str = "opinion_author_id") -> DataFrame:
    """``(judge_id, us_support_rate, us_support_n)`` over cases whose ruling can be read."""
    ruled = cases.select(F.col(key).alias("judge_id"), us_support(F.col("name"), F.col("opinion_text")).alias("r")).where("judge_id is not null and r is not null")
    return ruled.groupBy("judge_id").agg(F.avg("r").alias("us_support_rate"), F.count(F.lit(1)).alias("us_support_n"))


def politicality(cases: DataFrame, key: str = "district_judge_id", score: str = "politicality_score") -> DataFrame:
    """``(judge_id, politicality, politicality_n)``: mean score."""
    return cases.where(F.col(key).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(key).alias("judge_id")).agg(F.avg(score).alias("politicality"), F.count(F.lit(1)).alias("politicality_n"))


def citation_impact(cases: DataFrame, key: str = "opinion_author_id", cited: Column | None = None) -> DataFrame:
    """``(judge_id, citation_impact)``: mean of log(1 + times cited) over a judge's cases.

    ``cases(cite, cites_to, <key>)``; ``cited`` turns ``cites_to`` into an array of citations.
    """
    base = cases.where(F.col("cite").isNotNull() & F.col(key).isNotNull()).withColumn("cite", norm_string(F.col("cite")))
    is_array = dict(cases.dtypes)["cites_to"].startswith("array")
    listed = to_list(F.col("cites_to"), is_array) if cited is None else cited
    edges = base.select(F.explode(listed).alias("c")).where("c is not null").select(norm_string(F.col("c")).alias("cite"))
    counts = edges.groupBy("cite").agg(F.count(F.lit(1)).alias("n"))
    return base.join(counts, "cite", "left").groupBy(F.col(key).alias("judge_id")).agg(F.avg(F.log1p(F.coalesce("n", F.lit(0)))).alias("citation_impact"))


def cited_judges(cases: DataFrame, judge: str = "opinion_author_id", order: str = "ord") -> DataFrame:
    """``(cite, judge)``: the author of each citation; of cases with the same citation the last by ``order``."""
    return cases.where(F.col("cite").isNotNull()).groupBy(norm_string(F.col("cite")).alias("cite")).agg(F.max(F.struct(order, judge))[judge].alias("judge"))


def judges_named(judges: DataFrame, last_name: str) -> DataFrame:
    """Judges with exactly this last name."""
    return judges.where(F.col("last_name") == last_name)


#: Columns of a judge's row of features, in order; those that no table has are left out.
FEATURE_ROW = ["judge_id", "is_promoted", "overturn_rate", "prestige_index", "aba_rating", "gender", "ethnicity", "party", "us_support_rate", "politicality", "citation_impact"]


def judge_features(judges: DataFrame, *features: DataFrame) -> DataFrame:
    """One row per judge with every feature; judges are few, features join by id."""
    out = first_per(judges, ["judge_id"], ["ord"]) if "ord" in judges.columns else judges.dropDuplicates(["judge_id"])
    for f in features:
        out = out.join(f, "judge_id", "left")
    return out
