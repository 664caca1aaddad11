"""Classification requests and answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_id, strip, to_long, truncate_middle
from .relational import first_per
from .resolve import ids_from_names

# Fields of an answer and the shape of a request.
FIELDS = "opinion string, case_type string, error_category string, petitioner_type string, respondent_type string, politicality_score int, profile_level string, lower_judge_first string, lower_judge_last string"
URL = "/v1/chat/completions"
# What a field may hold; decoding and features expect these.
DOMAINS = {
    "opinion": ["affirmed", "reversed", "vacated", "remanded", "reversed and remanded", "modified"],
    "case_type": ["criminal", "civil", "tort", "labor", "contract", "bankruptcy", "other"],
    "error_category": ["legal error", "procedural error", "insufficient evidence", "constitutional violation", "abuse of discretion", "new or controlling precedent"],
    "petitioner_type": ["male", "female", "group of individuals", "company", "other"],
    "respondent_type": ["male", "female", "group of individuals", "company", "other"],
    "politicality_score": [1, 2, 3, 4, 5],
    "profile_level": ["low", "medium", "high"],
}
MEANINGS = {
    "opinion": "what the appellate court did with the decision under review",
    "case_type": "the kind of case",
    "error_category": "the main ground of the decision",
    "petitioner_type": "who appeals",
    "respondent_type": "who answers the appeal",
    "politicality_score": "how political or disputed the matter is, from routine (1) to a national controversy (5)",
    "profile_level": "how well known the people and organisations involved are",
}
SYSTEM = (
    "Classify the appellate opinion. Answer with JSON only, with exactly the requested keys; a field that cannot be determined is null.\n"
    + "".join(f"- {k}: {MEANINGS[k]}; one of {', '.join(map(str, v))}.\n" for k, v in DOMAINS.items())
    + "- lower_judge_first, lower_judge_last: first and last name, without titles, of the judge of the court below, only if the text names that judge; "
    "judges of the appellate panel and counsel don't count."
)
DEVELOPER = "Always output valid JSON only, with the keys: " + ", ".join(f.split()[0] for f in FIELDS.split(", ")) + "."
USER = "Classify this appellate opinion:\n\n"
TOKEN = r"(?U)\s*\w+|\s*[^\w\s]|\s+"


def answer_text(response: Column) -> Column:
    """Answer of a response in any of its shapes (text column holding JSON): chat, output text or output parts."""
    at = lambda p: F.get_json_object(response, p)
    parts = F.from_json(at("$.output"), "array<struct<content:array<struct<text:string>>>>")
    texts = F.filter(F.flatten(F.transform(parts, lambda m: F.transform(F.coalesce(m["content"], F.array().cast("array<struct<text:string>>")), lambda p: p["text"]))), lambda t: t.isNotNull())
    return F.coalesce(at("$.body.choices[0].message.content"), at("$.output_text"), F.when(F.size(texts) > 0, F.array_join(texts, "")))


def decode_answers(lines: DataFrame, column: str = "value") -> DataFrame:
    """Answers of response lines; blank lines, errors, bad JSON and answers that are no object are dropped."""
    v = F.col(column)
    error = F.get_json_object(v, "$.error")
    truthy = F.coalesce(~error.isin("", "null", "false", "0", "[]", "{}"), F.lit(False))
    content = F.get_json_object(v, "$.response.body.choices[0].message.content")
    good = lines.where(strip(v) != "").where(~truthy).select(F.get_json_object(v, "$.custom_id").alias("custom_id"), content.alias("_c"))
    good = good.where(F.expr("try_parse_json(_c) is not null") & strip(F.col("_c")).startswith("{"))
    return good.select("custom_id", F.from_json("_c", FIELDS).alias("a")).select("custom_id", "a.*")


def truncate_text(text: Column, most: int) -> Column:
    """First and last ``most`` tokens of a longer text (word and punctuation tokens with their leading space)."""
    return F.array_join(truncate_middle(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), most), "")


def truncate_by_tokenizer(df: DataFrame, column: str, most: int, make: Callable[[], object]) -> DataFrame:
    """``df`` with the first and last ``most`` tokens of longer texts of ``column``; null counts as empty.

    ``make`` returns the tokenizer, with ``encode(text)`` and ``decode(ids)``; it is called once a task.
    """
    columns = df.columns

    def run(batches):
        import pyarrow as pa

        coder = make()
        for batch in batches:
            out = []
            for text in batch.column(column).to_pylist():
                ids = coder.encode(text or "")
                out.append(coder.decode([*ids[:most], *ids[-most:]]) if len(ids) > most else text or "")
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == column else batch.column(c) for c in columns], columns)

    return df.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema))


def build_texts(cases: DataFrame, most: int = 3000, limit: int | None = None, make: Callable[[], object] | None = None, order: str = "ord") -> DataFrame:
    """``(custom_id, text)`` of the appellate cases, or of the first ``limit`` by ``order``, cut to ``most`` tokens at each end.

    Tokens are those of the tokenizer that ``make`` returns, or words and punctuation without one.
    """
    some = cases.where("is_appellate = 1")
    some = some if limit is None else some.orderBy(order).limit(limit)
    rows = some.select(F.col("unique_id").cast("string").alias("custom_id"), F.col("opinion_text").alias("text"))
    return rows.withColumn("text", truncate_text(F.col("text"), most)) if make is None else truncate_by_tokenizer(rows, "text", most, make)


def build_requests(cases: DataFrame, most: int = 3000, model: str = "gpt-4o", limit: int | None = None, make: Callable[[], object] | None = None) -> DataFrame:
    """``(custom_id, value)``: one JSON request per text of ``build_texts``."""
    say = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    body = F.struct(F.lit(model).alias("model"), F.array(say("system", F.lit(SYSTEM)), say("developer", F.lit(DEVELOPER)), say("user", F.concat(F.lit(USER), F.col("text")))).alias("messages"))
    return build_texts(cases, most, limit, make).select("custom_id", F.to_json(F.struct("custom_id", F.lit("POST").alias("method"), F.lit(URL).alias("url"), body.alias("body"))).alias("value"))


def unanswered(cases: DataFrame, answered: DataFrame, key: str = "unique_id") -> DataFrame:
    """Cases without an answer yet."""
    ids = answered.select(F.col(key).cast("string").alias("_k")).where("_k is not null").distinct()
    return cases.join(ids, cases[key].cast("string") == ids["_k"], "left_anti")


BASE = ["unique_id", "name", "opinion_text", "docket_number", "district_judge", "district_judge_id", "decision_date"]


def _answer_columns(answers: DataFrame) -> list[str]:
    return [c for c in answers.columns if c not in ("custom_id", "lower_judge_first", "lower_judge_last")]


def attach_to_opinions(cases: DataFrame, answers: DataFrame, judges: DataFrame) -> DataFrame:
    """Opinions with answers; judge and id come from the answered names."""
    joined = cases.drop("district_judge", "district_judge_id").join(answers, cases["unique_id"].cast("string") == answers["custom_id"], "left")
    named = ids_from_names(joined, judges).withColumnRenamed("judge_id", "district_judge_id").withColumn("district_judge", F.lower(strip(F.coalesce("lower_judge_last", F.lit("")))))
    keep = [c for c in BASE if c in named.columns] + [c for c in _answer_columns(answers) if c in named.columns]
    return named.select(keep)


def attach_to_linked(cases: DataFrame, mapping: DataFrame, answers: DataFrame, prefix: str = "CAP_") -> DataFrame:
    """Linked appellate cases with trial judge and answers; ids get ``prefix`` (which answers may already have)."""
    key = norm_id(F.col("unique_id"))
    trial = first_per(cases, ["unique_id"], ["ord"]).select(key.alias("district_uid"), F.col("opinion_author_clean").alias("district_judge"), to_long(F.col("opinion_author_id")).alias("district_judge_id"))
    linked = cases.drop("district_judge", "district_judge_id").withColumn("_id", key).join(mapping.select(F.col("appellate_uid").alias("_id"), "district_uid"), "_id").join(trial, "district_uid", "left")
    plain = answers.withColumn("_id", F.regexp_replace("custom_id", f"^{prefix}", "")).drop("custom_id")
    out = linked.join(plain, "_id", "left").withColumn("unique_id", F.concat(F.lit(prefix), F.col("_id")))
    keep = [c for c in BASE if c in out.columns] + [c for c in _answer_columns(answers) if c in out.columns]
    return out.select(keep)
