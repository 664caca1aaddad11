"""Confirmation of uncertain links and attachment of the trial judge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_any, docket_tokens, first_dockets, judge_needles
from ..session import staged
from .relational import first_per
from .similarity import link_cases


def confirm(matches: DataFrame, cases: DataFrame) -> DataFrame:
    """``matches`` with ``confirm_reason``: 'docket', 'judge' or null.

    A docket of the appellate text is the trial docket, or else the text names the trial judge.
    """
    texts = cases.select("circuit", F.col("doc").alias("a"), F.col("opinion_text").alias("_text")).join(matches.select("circuit", "a"), ["circuit", "a"], "semi")
    trial = cases.select("circuit", F.col("doc").alias("d"), F.col("docket_number").alias("_docket"), F.col("opinion_author_raw").alias("_author")).join(matches.select("circuit", "d"), ["circuit", "d"], "semi")
    docket = F.arrays_overlap(first_dockets(F.col("_text")), docket_tokens(F.col("_docket")))
    judge = contains_any(F.col("_text"), judge_needles(F.col("_author")))
    joined = matches.join(texts, ["circuit", "a"], "left").join(trial, ["circuit", "d"], "left")
    return joined.withColumn("confirm_reason", F.when(docket, "docket").when(judge, "judge")).drop("_text", "_docket", "_author")


def run_linking(cases: DataFrame, high: float = 0.8, cutoff: float = 0.65, **options: float) -> DataFrame:
    """Accepted links: scores from ``high`` on, and confirmed ones from ``cutoff`` on."""
    found = confirm(staged(link_cases(cases, cutoff=cutoff, **options), "links"), cases)  # links are few, and read three times
    band = F.when(F.col("score") >= high, "high").otherwise("mid")
    return found.withColumn("band", band).where("band = 'high' or confirm_reason is not null")


def attach_trial_judge(cases: DataFrame, links: DataFrame) -> DataFrame:
    """Linked appellate cases with the author of the trial case; those without an author id go."""
    pairs = links.select("circuit", F.col("a").alias("doc"), F.col("d").alias("district_uid"))
    linked = cases.join(pairs.select("circuit", F.col("district_uid").alias("doc")), ["circuit", "doc"], "semi")
    trial = first_per(linked, ["circuit", "doc"], ["ord"]).select("circuit", F.col("doc").alias("district_uid"), F.col("opinion_author_clean").alias("district_judge"), F.col("opinion_author_id").alias("district_judge_id"))
    return cases.drop("district_judge", "district_judge_id").join(pairs, ["circuit", "doc"]).join(trial, ["circuit", "district_uid"]).where("district_judge_id is not null")
