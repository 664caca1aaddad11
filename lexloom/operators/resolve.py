"""Judge names to judge ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.courts import extract_court, extract_judge, mentions_trial_court
from ..functions.text import canon, split_name, strip, to_long
from .relational import first_per


def resolve_judges(named: DataFrame, judges: DataFrame) -> DataFrame:
    """``named(case_id, judge, court)`` with ``district_judge`` (last name) and ``district_judge_id``.

    A unique last name decides; else a unique first and last name; else the first judge of that
    name whose court contains or is contained in the given one; else a unique court hit among
    all of that last name; else null.  Rows count by appointment.
    """
    j = judges.select(
        to_long(F.col("judge_id")).alias("jid"), F.col("ord"), canon(F.col("last_name")).alias("last_key"), canon(F.regexp_extract(F.col("first_name"), r"^\s*(\S+)", 1)).alias("j_first"), canon(F.col("court_name")).alias("j_court")
    )
    parts = split_name(F.col("judge"))
    n = named.withColumn("_p", parts).select("*", F.lower("_p.last").alias("district_judge"), canon(F.col("_p.last")).alias("last_key"), canon(F.col("_p.first")).alias("first_key"), canon(F.col("court")).alias("court_key")).drop("_p")
    # Cases and judges meet as distinct names and courts with their counts: no row is made for each case and judge.
    j = j.where("last_key <> ''").groupBy("last_key", "j_first", "j_court").agg(F.count(F.lit(1)).alias("rows"), F.min(F.struct("ord", "jid")).alias("least"))
    keys = ["last_key", "first_key", "court_key"]
    wanted = n.where("last_key <> ''").select(*keys).distinct()

    def counted(names: str, first: bool, court: bool) -> DataFrame:
        """Per distinct name (and court) of the cases: judges' rows, and the first of them."""
        on = ["last_key", *(["first_key"] if first else [])]
        mine = j.where("j_first <> ''").withColumnRenamed("j_first", "first_key") if first else j
        out = [F.sum("rows").alias(f"n_{names}"), F.min("least").alias(f"by_{names}")]
        if not court:
            return mine.groupBy(*on).agg(*out)
        hit = (F.col("court_key") != "") & (F.col("j_court") != "") & (F.contains("j_court", "court_key") | F.contains("court_key", "j_court"))
        mine = mine.groupBy(*on, "j_court").agg(F.sum("rows").alias("rows"), F.min("least").alias("least"))
        return wanted.select(*on, "court_key").distinct().join(mine, on).where(hit).groupBy(*on, "court_key").agg(*out)

    found = wanted
    for name, first, court in (("last", False, False), ("first", True, False), ("both", True, True), ("court", False, True)):
        found = found.join(counted(name, first, court), ["last_key", *(["first_key"] if first else []), *(["court_key"] if court else [])], "left")
    names = ["last", "first", "both", "court"]
    found = n.select("case_id", *keys).join(found, keys).groupBy("case_id").agg(*(F.sum(f"n_{x}").alias(f"n_{x}") for x in names), *(F.min(f"by_{x}")["jid"].alias(f"by_{x}") for x in names))
    jid = F.when(F.col("n_last") == 1, F.col("by_last")).when(F.col("n_first") == 1, F.col("by_first")).when((F.col("n_first") > 1) & (F.col("n_both") >= 1), F.col("by_both")).when(F.col("n_court") == 1, F.col("by_court"))
    out = n.join(found.select("case_id", jid.alias("district_judge_id")), "case_id", "left")
    return out.drop("last_key", "first_key", "court_key")


def clean_opinions(raw: DataFrame, judges: DataFrame, circuit: str) -> DataFrame:
    """Opinions that mention a trial court, with judge and id read from the text; unresolved ones go.

    ``raw(circuit?, _cid, name, docket_number, decision_date, opinion_text)``; ids are 'CL_' and the source id.
    """
    hits = raw.where(mentions_trial_court(F.col("opinion_text")))
    named = hits.select("*", F.col("_cid").alias("case_id"), extract_judge(F.col("opinion_text"), circuit).alias("judge"), extract_court(F.col("opinion_text")).alias("court"))
    done = resolve_judges(named, judges).where("district_judge_id is not null")
    return done.select("name", "docket_number", "decision_date", "opinion_text", "district_judge", "district_judge_id", F.lit(1).alias("is_appellate"), F.concat(F.lit("CL_"), F.col("case_id").cast("string")).alias("unique_id"))


def ids_from_names(answers: DataFrame, judges: DataFrame) -> DataFrame:
    """``answers`` with ``judge_id`` by exact first and last name (trimmed, any case); the first duplicate wins."""
    if "lower_judge_first" not in answers.columns or "lower_judge_last" not in answers.columns:
        return answers.withColumn("judge_id", F.lit(None).cast("long"))
    key = lambda c: F.lower(strip(F.col(c)))
    j = judges.select(key("first_name").alias("_fn"), key("last_name").alias("_ln"), to_long(F.col("judge_id")).alias("judge_id"), "ord")
    j = first_per(j.where("_fn is not null and _ln is not null"), ["_fn", "_ln"], ["ord"]).drop("ord")
    return answers.withColumns({"_fn": key("lower_judge_first"), "_ln": key("lower_judge_last")}).join(j, ["_fn", "_ln"], "left").drop("_fn", "_ln")
