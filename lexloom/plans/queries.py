"""Registered queries of the case, judge and answer operators, each with its DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import courts, rulings, text
from ..functions.unicode import ascii_fold, nfkd_size
from ..operators import answers, features, linkage, relational, resolve, similarity
from ..session import shared_folder, staged
from ..sources import files
from ..sources.html import html_text_closed
from ..streaming.incremental import skip_seen
from . import views
from .views import CASES, CITES, JUDGES, RESPONSES_DUCK, cases, cites, frame, judges, responses

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- judge features

_PROMO = f"""v_judge AS ({JUDGES}), info AS (
  SELECT judge_id, max(CASE WHEN lower(court_type) LIKE '%district%' THEN 1 ELSE 0 END) AS district,
         max(CASE WHEN regexp_matches(lower(court_type), 'appeal|circuit') THEN 1 ELSE 0 END) AS is_promoted,
         min(CASE WHEN regexp_matches(lower(court_type), 'appeal|circuit') THEN nomination_date END) AS promotion_date
  FROM v_judge GROUP BY judge_id)"""

_OVERTURN = f"""{_PROMO}, v_case AS ({CASES}), counted AS (
  SELECT j.judge_id, count(c.unique_id) AS appealed, sum(CASE WHEN coalesce(lower(c.opinion), '') <> 'affirmed' THEN 1 ELSE 0 END)::BIGINT AS overturned
  FROM v_case c JOIN info j ON c.district_judge_id = j.judge_id
  WHERE c.decision_date IS NOT NULL AND (j.promotion_date IS NULL OR c.decision_date <= j.promotion_date - INTERVAL 3 MONTH) GROUP BY j.judge_id)"""


@query(f"WITH {_PROMO} SELECT judge_id, is_promoted, promotion_date FROM info WHERE district = 1")
def promotion_info(spark, sf_dir):
    return features.promotion_info(judges(spark, sf_dir)).select("judge_id", "is_promoted", "promotion_date")


@query(f"WITH {_PROMO} SELECT judge_id, is_promoted FROM info")
def promotion_label(spark, sf_dir):
    return features.is_promoted(judges(spark, sf_dir))


@query(f"WITH {_OVERTURN} SELECT i.judge_id, coalesce(appealed, 0) AS appealed, coalesce(overturned, 0) AS overturned, round(CASE WHEN appealed > 0 THEN overturned / appealed END, 9) AS overturn_rate FROM info i LEFT JOIN counted c ON i.judge_id = c.judge_id WHERE district = 1")
def overturn_rate(spark, sf_dir):
    out = features.overturn_rate(features.promotion_info(judges(spark, sf_dir)), cases(spark, sf_dir))
    return out.withColumn("overturn_rate", F.round("overturn_rate", 9))


_CITES = f"""v_cite AS ({CITES}), base AS (SELECT trim(lower(cite)) AS cite, opinion_author_id, cites_to FROM v_cite WHERE cite IS NOT NULL AND opinion_author_id IS NOT NULL),
n AS (SELECT trim(lower(cites_to)) AS cite, count(*) AS n FROM base GROUP BY 1),
impact AS (SELECT opinion_author_id AS judge_id, round(avg(ln(1 + coalesce(n.n, 0))), 9) AS citation_impact FROM base LEFT JOIN n ON base.cite = n.cite GROUP BY 1)"""


@query(f"WITH {_CITES} SELECT judge_id, citation_impact FROM impact")
def citation_impact(spark, sf_dir):
    return features.citation_impact(cites(spark, sf_dir)).withColumn("citation_impact", F.round("citation_impact", 9))


@query("SELECT user_id AS judge_id, round(avg(value), 6) AS politicality, count(*) AS politicality_n FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL GROUP BY 1")
def politicality(spark, sf_dir):
    return features.politicality(_read(spark, sf_dir, "events"), "user_id", "value").withColumn("politicality", F.round("politicality", 6))


_RULING = """CASE c_custkey % 9 WHEN 0 THEN 'The court granted the motion to suppress.' WHEN 1 THEN 'We denied the motion to suppress.'
  WHEN 2 THEN 'demurrer overruled' WHEN 3 THEN 'Demurrer sustained' WHEN 4 THEN 'motion to quash the indictment is denied' WHEN 5 THEN 'The government has not shown; it failed to prove intent.'
  WHEN 6 THEN 'Judgment for the United States.' WHEN 7 THEN 'judgment for the defendant' ELSE 'nothing decided' END"""
_CAPTION = "CASE c_custkey % 4 WHEN 0 THEN 'United States v. ' || c_name WHEN 1 THEN c_name || ' v. United States' WHEN 2 THEN c_name || ' vs. U.S.' ELSE 'In re ' || c_name END"
_SUPPORT = f"""r AS (SELECT c_nationkey AS judge_id, c_custkey % 4 IN (1, 2) AS us_defends, c_custkey % 9 AS k FROM customer),
v AS (SELECT judge_id, CASE WHEN k IN (0, 3, 5) THEN CASE WHEN us_defends THEN 1 ELSE 0 END WHEN k IN (1, 2, 4) THEN CASE WHEN us_defends THEN 0 ELSE 1 END WHEN k = 6 THEN 1 WHEN k = 7 THEN 0 END AS r FROM r)"""


@query(f"WITH {_SUPPORT} SELECT judge_id, round(avg(r), 9) AS us_support_rate, count(*) AS us_support_n FROM v WHERE judge_id IS NOT NULL AND r IS NOT NULL GROUP BY 1")
def us_support(spark, sf_dir):
    rows = frame(spark, sf_dir, f"SELECT c_nationkey AS opinion_author_id, {_CAPTION} AS name, {_RULING} AS opinion_text FROM customer")
    return features.us_support_rate(rows).withColumn("us_support_rate", F.round("us_support_rate", 9))


_BIO = """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Harvard University' WHEN 1 THEN 'Yale Law School' END AS school_1, CASE WHEN c_custkey % 5 = 0 THEN 'Ohio State' END AS school_2,
  CASE WHEN c_custkey % 2 = 0 THEN 'J.D.' END AS degree_1, 'A.B.' AS degree_2,
  CASE c_custkey % 7 WHEN 0 THEN 'Law clerk, U.S. Court of Appeals; Professor of law' WHEN 1 THEN 'Adjunct professor' WHEN 2 THEN 'assistant professor' WHEN 3 THEN NULL ELSE 'Private practice' END AS career FROM customer"""


@query(f"""WITH b AS ({_BIO}), s AS (SELECT c_custkey, lower(coalesce(school_1, '') || ' ' || coalesce(school_2, '')) AS s, lower(coalesce(degree_1, '') || ' ' || degree_2) AS d, lower(coalesce(career, '')) AS p FROM b)
SELECT c_custkey, ((regexp_matches(s, '(harvard|yale|columbia|michigan|stanford).*law') OR (regexp_matches(d, 'j\\.?d|ll\\.?b|llm|s\\.?j\\.?d') AND regexp_matches(s, 'harvard|yale|columbia|michigan|stanford')))::INT
 + regexp_matches(p, 'law clerk.*(supreme court|court of appeals|circuit)')::INT + (regexp_matches(p, '\\b(assistant|associate)?\\s*professor\\b') AND NOT regexp_matches(p, '\\b(adjunct|visiting|lecturer)\\b'))::INT) AS prestige_index FROM s""")
def prestige_index(spark, sf_dir):
    b = frame(spark, sf_dir, _BIO)
    return b.select("c_custkey", rulings.prestige([b.school_1, b.school_2], [b.degree_1, b.degree_2], b.career).alias("prestige_index"))


@query(f"WITH {_OVERTURN}, {_CITES} SELECT i.judge_id, i.is_promoted, round(CASE WHEN appealed > 0 THEN overturned / appealed END, 9) AS overturn_rate, citation_impact FROM info i LEFT JOIN counted c ON i.judge_id = c.judge_id LEFT JOIN impact m ON i.judge_id = m.judge_id WHERE district = 1")
def judge_features(spark, sf_dir):
    info = features.promotion_info(judges(spark, sf_dir))
    rate = features.overturn_rate(info, cases(spark, sf_dir)).select("judge_id", F.round("overturn_rate", 9).alias("overturn_rate"))
    return features.judge_features(info.select("judge_id", "is_promoted"), rate, citation_impact(spark, sf_dir))


_BIOS = """SELECT s_suppkey AS judge_id, CASE s_suppkey % 3 WHEN 0 THEN 'Harvard Law School' WHEN 1 THEN 'Yale University' ELSE 'Ohio State' END AS school, CASE WHEN s_suppkey % 2 = 0 THEN 'J.D.' END AS degree,
  CASE s_suppkey % 4 WHEN 0 THEN 'Law clerk, Court of Appeals' WHEN 1 THEN 'Professor' WHEN 2 THEN 'Visiting professor' END AS career, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 'Well Qualified' END AS aba_rating,
  CASE WHEN s_suppkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender, 'e' || CAST(s_suppkey % 6 AS VARCHAR(20)) AS ethnicity, CASE WHEN s_suppkey % 3 = 0 THEN 'A' ELSE 'B' END AS party FROM supplier"""
_SCORED = "SELECT l_suppkey AS district_judge_id, l_linenumber AS politicality_score FROM lineitem"


@query(f"""WITH {_OVERTURN}, {_CITES}, {_SUPPORT}, b AS ({_BIOS}), sup AS (SELECT judge_id, round(avg(r), 9) AS us_support_rate FROM v WHERE judge_id IS NOT NULL AND r IS NOT NULL GROUP BY 1),
pol AS (SELECT district_judge_id AS judge_id, round(avg(politicality_score), 9) AS politicality FROM ({_SCORED}) GROUP BY 1)
SELECT i.judge_id, is_promoted, round(CASE WHEN appealed > 0 THEN overturned / appealed END, 9) AS overturn_rate,
 (regexp_matches(lower(school), '(harvard|yale).*law') OR (degree IS NOT NULL AND regexp_matches(lower(school), 'harvard|yale')))::INT + coalesce(regexp_matches(lower(career), 'law clerk.*court of appeals'), false)::INT + coalesce(lower(career) = 'professor', false)::INT AS prestige_index,
 aba_rating, gender, ethnicity, party, us_support_rate, politicality, citation_impact
FROM info i LEFT JOIN counted c ON i.judge_id = c.judge_id LEFT JOIN b ON i.judge_id = b.judge_id LEFT JOIN sup ON i.judge_id = sup.judge_id LEFT JOIN pol ON i.judge_id = pol.judge_id LEFT JOIN impact m ON i.judge_id = m.judge_id WHERE district = 1""")
def judge_feature_row(spark, sf_dir):
    info = features.promotion_info(judges(spark, sf_dir))
    rate = features.overturn_rate(info, cases(spark, sf_dir)).select("judge_id", F.round("overturn_rate", 9).alias("overturn_rate"))
    bios = frame(spark, sf_dir, _BIOS)
    bios = bios.withColumn("prestige_index", rulings.prestige([bios.school], [bios.degree], bios.career)).drop("school", "degree", "career")
    scored = features.politicality(frame(spark, sf_dir, _SCORED)).select("judge_id", F.round("politicality", 9).alias("politicality"))
    out = features.judge_features(info, rate, bios, us_support(spark, sf_dir).select("judge_id", "us_support_rate"), scored, citation_impact(spark, sf_dir))
    return relational.keep_columns(out, features.FEATURE_ROW)


# ---------------------------------------------------------------- relational core


@query(f"WITH v_case AS ({CASES}) SELECT unique_id, docket_number, opinion_type FROM (SELECT *, row_number() OVER (PARTITION BY docket_number ORDER BY CASE WHEN lower(opinion_type) = 'majority' THEN 0 ELSE 1 END, ord) AS r FROM v_case WHERE is_appellate = 1) WHERE r = 1 UNION ALL SELECT unique_id, docket_number, opinion_type FROM v_case WHERE is_appellate <> 1")
def priority_dedupe(spark, sf_dir):
    return relational.priority_dedupe(cases(spark, sf_dir)).select("unique_id", "docket_number", "opinion_type")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def distinct_first(spark, sf_dir):
    return relational.first_per(_read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def semi_isin(spark, sf_dir):
    late = _read(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return _read(spark, sf_dir, "customer").join(late, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c.c_custkey AND o_orderpriority = '1-URGENT')")
def anti_isin(spark, sf_dir):
    urgent = _read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").cast("string").alias("unique_id"))
    rows = _read(spark, sf_dir, "customer").withColumn("unique_id", F.col("c_custkey"))
    return answers.unanswered(rows, urgent).select("c_custkey", "c_name")


@query("SELECT n_nationkey, n_name, s.s_suppkey FROM nation LEFT JOIN (SELECT s_nationkey, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY 1) s ON n_nationkey = s_nationkey")
def lookup_left(spark, sf_dir):
    s = _read(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")
    return relational.lookup(_read(spark, sf_dir, "nation"), s, "n_nationkey", "s_suppkey", ["s_suppkey"]).select("n_nationkey", "n_name", "s_suppkey")


@query("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")
def union_missing_cols(spark, sf_dir):
    a = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return a.unionByName(_read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), allowMissingColumns=True)


_MAIN = "SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE ' D' || CAST(o_orderkey % 500 AS VARCHAR(20)) END AS docket_number, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS district_judge_id, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS district_judge FROM orders"
_SIDE = "SELECT l_orderkey * 10 + l_linenumber AS ord, CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE 'D' || CAST(l_partkey % 700 AS VARCHAR(20)) || ' ' END AS docket_number, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_suppkey END AS district_judge_id, CASE WHEN l_linenumber = 2 THEN NULL ELSE l_returnflag END AS district_judge, l_tax FROM lineitem"


@query(f"""WITH a AS ({_MAIN}), b AS ({_SIDE}), k AS (SELECT trim(docket_number) AS k, (min({{'o': ord, 'v': district_judge_id}}) FILTER (district_judge_id IS NOT NULL)).v AS i, (min({{'o': ord, 'v': district_judge}}) FILTER (district_judge IS NOT NULL)).v AS j FROM b WHERE docket_number IS NOT NULL GROUP BY 1)
SELECT a.ord, a.docket_number, coalesce(a.district_judge_id, k.i) AS district_judge_id, coalesce(a.district_judge, k.j) AS district_judge FROM a LEFT JOIN k ON trim(a.docket_number) = k.k
UNION ALL SELECT ord, docket_number, district_judge_id, district_judge FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE trim(a.docket_number) = trim(b.docket_number))""")
def source_backfill_merge(spark, sf_dir):
    return relational.backfill_merge(frame(spark, sf_dir, _MAIN), frame(spark, sf_dir, _SIDE), "docket_number", ["district_judge_id", "district_judge"])


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS row_id FROM events")
def row_numbers(spark, sf_dir):
    return relational.row_numbers(_read(spark, sf_dir, "events"), ["ts", "event_id"]).select("event_id", "row_id")


@query("SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderdate BETWEEN a.o_orderdate - INTERVAL 7 YEAR AND a.o_orderdate WHERE a.o_orderkey % 50 = 0 AND b.o_orderkey % 50 <> 0")
def date_window_join(spark, sf_dir):
    o = _read(spark, sf_dir, "orders")
    a = o.where("o_orderkey % 50 = 0").select(F.col("o_orderkey").alias("a"), "o_custkey", F.col("o_orderdate").alias("ad"))
    b = o.where("o_orderkey % 50 <> 0").select(F.col("o_orderkey").alias("b"), "o_custkey", F.col("o_orderdate").alias("bd"))
    return a.join(b, "o_custkey").where("bd between ad - interval 7 years and ad").select("a", "b")


# ---------------------------------------------------------------- text functions

_STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)
_TOKENS = "list_filter(string_split_regex(%s, '\\s+'), lambda t: t <> '')"


def _norm_sql(x: str) -> str:
    out = f"regexp_replace(lower(coalesce({x}, '')), '\\bvs?\\.?\\b', ' ', 'g')"
    for pattern, by in text.REPLACEMENTS:
        out = f"regexp_replace({out}, '{pattern}', '{by}', 'g')"
    out = f"regexp_replace({out}, '[^\\w\\s]', ' ', 'g')"
    return f"array_to_string(list_filter({_TOKENS % out}, lambda t: t NOT IN ({_STOP})), ' ')"


_NAMES = "SELECT c_custkey AS k, c_name || CASE c_custkey % 5 WHEN 0 THEN ' Company, Inc. vs. Jones' WHEN 1 THEN ' h/w v. The State of Maine' WHEN 2 THEN ' & Co.' WHEN 3 THEN ' versus V. Roe  v. Doe' ELSE '' END AS name FROM customer"
_LEFT, _RIGHT = ("trim(lower(regexp_extract(regexp_replace(name, '\\s+', ' ', 'g'), '(?i)^(.*)\\s+(?:v(?:\\.|s\\.?)?|versus)\\s+(.*)$', %d)))" % i for i in (1, 2))


@query(f"WITH n AS ({_NAMES}) SELECT k, {_norm_sql('name')} AS norm FROM n")
def caption_normalize(spark, sf_dir):
    return frame(spark, sf_dir, _NAMES).select("k", text.normalize_caption(F.col("name")).alias("norm"))


@query(f"WITH n AS ({_NAMES}), s AS (SELECT k, {_LEFT} AS l, {_RIGHT} AS r FROM n) SELECT k, CASE WHEN l <> '' AND r <> '' THEN l END AS left_side, CASE WHEN l <> '' AND r <> '' THEN r END AS right_side FROM s")
def caption_split(spark, sf_dir):
    return frame(spark, sf_dir, _NAMES).select("k", text.split_caption(F.col("name")).alias("p")).select("k", F.col("p.left").alias("left_side"), F.col("p.right").alias("right_side"))


def _dockets_sql(x: str) -> str:
    parts = f"string_split_regex(regexp_replace({x}, '\\b[Nn]os?\\.\\s*', '', 'g'), '[,;/\\s]+')"
    return f"array_to_string(list_filter(list_transform({parts}, lambda p: upper(regexp_replace(p, '[^A-Za-z0-9\\-/.]+', '', 'g'))), lambda p: p <> ''), '|')"


@query(f"WITH v_case AS ({CASES}) SELECT unique_id, coalesce({_dockets_sql('docket_number')}, '') AS dockets FROM v_case")
def docket_tokens(spark, sf_dir):
    return cases(spark, sf_dir).select("unique_id", F.array_join(text.docket_tokens(F.col("docket_number")), "|").alias("dockets"))


_BLOCK = "regexp_extract(opinion_text, '\\b[Nn]os?\\.\\s*[A-Za-z0-9\\-_/\\. ,;]+')"


@query(f"WITH v_case AS ({CASES}) SELECT unique_id, list_has_any(string_split({_dockets_sql(_BLOCK)}, '|'), string_split(coalesce({_dockets_sql('docket_number')}, ''), '|')) AS overlaps FROM v_case")
def docket_overlap(spark, sf_dir):
    a, b = text.first_dockets(F.col("opinion_text")), text.docket_tokens(F.col("docket_number"))
    return cases(spark, sf_dir).select("unique_id", F.arrays_overlap(a, b).alias("overlaps"))


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'x' THEN '' ELSE concat_ws('|', CASE WHEN upper(c_mktsegment) = c_mktsegment THEN c_mktsegment END, 'SMITH', 'JOHN SMITH') END AS needles FROM customer")
def judge_needles(spark, sf_dir):
    raw = F.concat(F.col("c_mktsegment"), F.lit(", District Judge and JOHN A. SMITH, JR. IV"))
    return _read(spark, sf_dir, "customer").select("c_custkey", F.array_join(text.judge_needles(raw), "|").alias("needles"))


# Word characters and white space of any script, for classes of DuckDB's regular expressions.
_WORD = "\\p{L}\\p{M}\\p{Nd}\\p{Nl}\\p{Pc}"
_BLANK = "\\s\\x{0B}\\x{85}\\p{Z}"


@query(f"SELECT doc_id, regexp_matches(lower(coalesce(text, '')), '(^|[^{_WORD}])the([^{_WORD}]|$)') OR contains(lower(coalesce(text, '')), 'with that') AS hit FROM documents")
def name_contains(spark, sf_dir):
    needles = F.array(F.lit("The"), F.lit("With that"))
    return _read(spark, sf_dir, "documents").select("doc_id", text.contains_any(F.col("text"), needles).alias("hit"))


_IDS = "SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderkey AS VARCHAR(20)) || '.0' WHEN 1 THEN ' ' || CAST(o_orderkey AS VARCHAR(20)) || ' ' WHEN 2 THEN 'x.0' ELSE CAST(o_orderkey AS VARCHAR(20)) || '.50' END AS id FROM orders"


@query(f"WITH i AS ({_IDS}) SELECT k, CASE WHEN trim(id) LIKE '%.0' THEN coalesce(CAST(TRY_CAST(TRY_CAST(trim(id) AS DOUBLE) AS BIGINT) AS VARCHAR), trim(id)) ELSE trim(id) END AS id FROM i")
def norm_id(spark, sf_dir):
    return frame(spark, sf_dir, _IDS).select("k", text.norm_id(F.col("id")).alias("id"))


@query("SELECT n_nationkey, 'ca' || CAST(n_nationkey AS VARCHAR) AS code FROM nation")
def norm_circuit(spark, sf_dir):
    return _read(spark, sf_dir, "nation").select("n_nationkey", text.norm_circuit(F.concat(F.col("n_nationkey").cast("string"), F.lit("th"))).alias("code"))


@query("SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'third' WHEN 1 THEN 'eleventh' END AS circuit FROM nation")
def infer_circuit(spark, sf_dir):
    kind = F.element_at(F.array(F.lit("U.S. Court of Appeals for the Third Circuit"), F.lit("Eleventh Cir., Ct. Appeals"), F.lit("Second District")), F.col("n_nationkey") % 3 + 1)
    return _read(spark, sf_dir, "nation").select("n_nationkey", text.infer_circuit(kind).alias("circuit"))


@query("SELECT n_nationkey, regexp_replace(lower(n_name || ' S.D.'), '[^a-z]', '', 'g') AS canon FROM nation")
def canon(spark, sf_dir):
    return _read(spark, sf_dir, "nation").select("n_nationkey", text.canon(F.concat("n_name", F.lit(" S.D."))).alias("canon"))


@query("SELECT p_partkey, trim(regexp_replace(lower('  ' || p_name || chr(9) || ' ' || p_type), '\\s+', ' ', 'g')) AS norm FROM part")
def norm_string(spark, sf_dir):
    return _read(spark, sf_dir, "part").select("p_partkey", text.norm_string(F.concat(F.lit("  "), "p_name", F.lit("\t "), "p_type")).alias("norm"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN '' ELSE p_brand || '|' || p_type END AS items FROM part")
def to_list(spark, sf_dir):
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("['"), "p_brand", F.lit("', '"), "p_type", F.lit("']"))).when(F.col("p_partkey") % 3 == 1, F.concat("p_brand", F.lit(" ,, "), "p_type"))
    return _read(spark, sf_dir, "part").select("p_partkey", F.array_join(text.to_list(raw), "|").alias("items"))


@query("SELECT c_custkey, 'Jane' AS first_name, regexp_replace(c_mktsegment, '[^A-Za-z]', '', 'g') AS last_name FROM customer")
def split_name(spark, sf_dir):
    full = F.concat(F.lit(" The Honorable Jane Q. "), F.regexp_replace("c_mktsegment", "[^A-Za-z]", ""), F.lit(", Jr. III;"))
    return _read(spark, sf_dir, "customer").select("c_custkey", text.split_name(full).alias("n")).select("c_custkey", F.col("n.first").alias("first_name"), F.col("n.last").alias("last_name"))


@query()
def ascii_text(spark, sf_dir):
    """Every text in ASCII; DuckDB has no compatibility decomposition."""
    return _read(spark, sf_dir, "documents").select("doc_id", ascii_fold("text").alias("folded"))


@query()
def nfkd_length(spark, sf_dir):
    """Length of every text after decomposition."""
    return _read(spark, sf_dir, "documents").select("doc_id", nfkd_size("text").alias("n"))


# ---------------------------------------------------------------- scans


@query("SELECT n_nationkey, n_name AS court_name, CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 0 END AS is_appellate FROM nation WHERE contains(lower(n_name), 'nation_1') OR contains(lower(n_name), 'ion_7')")
def court_filter(spark, sf_dir):
    n = _read(spark, sf_dir, "nation").withColumnRenamed("n_name", "court_name")
    flag = files.appellate_flag(F.when(F.col("n_nationkey") % 2 == 0, F.lit("Court of APPEALS")).otherwise(F.lit("district")))
    return files.court_filter(n, ["Nation_1", "ION_7"]).select("n_nationkey", "court_name", flag.alias("is_appellate"))


_LAKE = """SELECT CASE o_orderkey % 4 WHEN 0 THEN 'D. Delaware' WHEN 1 THEN 'Court of Appeals, Third Circuit' WHEN 2 THEN 'D. Maine' ELSE 'Court of Appeals of Kansas' END AS court_name,
  'case ' || CAST(o_orderkey AS VARCHAR(20)) AS name, 'D' || CAST(o_orderkey AS VARCHAR(20)) AS docket_number, opinion_type, o_orderdate AS decision_date
  FROM (SELECT *, 'Majority' AS opinion_type FROM orders UNION ALL SELECT *, 'dissent' FROM orders WHERE o_orderkey % 3 = 0)"""


@query(f"SELECT name, docket_number, opinion_type, CASE WHEN court_name LIKE '%Kansas' THEN '10th' ELSE '3rd' END AS circuit, CASE WHEN court_name LIKE 'Court%' THEN 1 ELSE 0 END AS is_appellate FROM ({_LAKE}) WHERE court_name NOT LIKE '%Maine' AND NOT (court_name LIKE 'Court%' AND opinion_type = 'dissent')")
def cases_of_circuits(spark, sf_dir):
    """Two circuits read from a lake of opinions, one appellate case per docket."""
    lake = f"{shared_folder(spark)}/lexloom/lake-{uuid.uuid4().hex}"
    frame(spark, sf_dir, _LAKE).write.parquet(lake)
    return files.read_cases(spark, lake, ["3rd", "10th"]).select("name", "docket_number", "opinion_type", "circuit", "is_appellate")


@query("SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{kind}', '{p}')" for c, pair in files.CIRCUITS.items() for kind, ps in zip(("appellate", "district"), pair, strict=True) for p in ps) + ") t(circuit, kind, court_pattern)")
def circuit_dimension(spark, sf_dir):
    return files.circuit_table(spark)


@query("SELECT CAST(o_orderkey AS VARCHAR) AS appellate_uid, CAST(o_custkey AS VARCHAR) AS district_uid FROM orders WHERE o_orderkey % 6 <> 0")
def mapping_load(spark, sf_dir):
    o = _read(spark, sf_dir, "orders")
    value = F.when(F.col("o_orderkey") % 6 == 0, F.lit("")).otherwise(F.concat(F.col("o_custkey").cast("string"), F.lit(".0")))
    return files.mapping_rows(o.select(F.to_json(F.create_map(F.concat(F.col("o_orderkey").cast("string"), F.lit(".0")), value)).alias("value")))


# Tags in a row part two text nodes, as one line break; the references are those that the pages have.
_UNTAGGED = "regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<(script|style)\\b.*?</(script|style)>', '<x>', 'g'), '(?s)(<!--.*?-->|<[^>]*>)+', chr(10), 'g')"
for _name, _char in (("copy", 169), ("middot", 183), ("quot", 34), ("lt", 60), ("gt", 62), ("amp", 38)):
    _UNTAGGED = f"replace({_UNTAGGED}, '&{_name};', chr({_char}))"


@query(f"SELECT page_id, trim(regexp_replace({_UNTAGGED}, '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS text FROM pages")
def html_plain_text(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", html_text_closed("html").alias("text"))


@query("SELECT event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 150 AND user_id IS NOT NULL) OR user_id IS NULL")
def resume_unseen(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    return skip_seen(e, e.where("event_type = 'error' and value > 150"), "user_id").select("event_id")


# ---------------------------------------------------------------- requests and answers


@query(f"WITH r AS ({RESPONSES_DUCK}) SELECT 'CAP_' || CAST(k AS VARCHAR) AS custom_id, CASE o_orderstatus WHEN 'F' THEN 'affirmed' ELSE 'vacated' END AS opinion, CAST(1 + k % 5 AS INT) AS politicality_score FROM r JOIN orders ON k = o_orderkey WHERE k % 17 <> 0 AND k % 19 <> 0 AND k % 23 <> 0")
def answers_decode(spark, sf_dir):
    return answers.decode_answers(responses(spark, sf_dir)).select("custom_id", "opinion", "politicality_score")


def _ends_sql(x: str, most: int) -> str:
    """First and last tokens of a text."""
    t = f"regexp_extract_all(coalesce({x}, ''), '[{_BLANK}]*[{_WORD}]+|[{_BLANK}]*[^{_WORD}{_BLANK}]|[{_BLANK}]+')"
    return f"list_transform([{t}], lambda t: array_to_string(CASE WHEN len(t) > {most} THEN t[1:{most}] || t[-{most}:] ELSE t END, ''))[1]"


@query(f"SELECT conv_id, turn, {_ends_sql('text', 3)} AS text FROM conversations")
def truncate_tokens(spark, sf_dir):
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", answers.truncate_text(F.col("text"), 3).alias("text"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_DOCS = "SELECT doc_id AS ord, doc_id AS unique_id, CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS is_appellate, text AS opinion_text FROM documents"


@query(
    f"SELECT CAST(unique_id AS VARCHAR) AS custom_id, 'POST' AS method, '{answers.URL}' AS url, 'gpt-4o' AS model, {_quoted(answers.SYSTEM)} AS system, {_quoted(answers.DEVELOPER)} AS developer, "
    f"{_quoted(answers.USER)} || {_ends_sql('opinion_text', 40)} AS content FROM ({_DOCS}) WHERE is_appellate = 1"
)
def request_build(spark, sf_dir):
    r = answers.build_requests(frame(spark, sf_dir, _DOCS), most=40)
    at = lambda p: F.get_json_object("value", p)
    roles = {"system": 0, "developer": 1, "content": 2}
    return r.select("custom_id", at("$.method").alias("method"), at("$.url").alias("url"), at("$.body.model").alias("model"), *(at(f"$.body.messages[{i}].content").alias(n) for n, i in roles.items()))


@query(f"SELECT CAST(unique_id AS VARCHAR) AS custom_id, {_ends_sql('opinion_text', 5)} AS text FROM ({_DOCS}) WHERE is_appellate = 1 ORDER BY ord LIMIT 25")
def first_texts(spark, sf_dir):
    """The first texts only: the limit is the feature."""
    return answers.build_texts(frame(spark, sf_dir, _DOCS), 5, limit=25)


_PREFIXED = "SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'CAP_' ELSE 'id_' END || CAST(o_orderkey AS VARCHAR(20)) AS custom_id FROM orders"


@query(f"SELECT bool_or(starts_with(custom_id, 'CL_')) AS CL_, bool_or(starts_with(custom_id, 'CAP_')) AS CAP_ FROM ({_PREFIXED})")
def id_prefixes(spark, sf_dir):
    return relational.any_with_prefix(frame(spark, sf_dir, _PREFIXED), "custom_id", "CL_", "CAP_")


_HIGH = "SELECT CAST(o_orderkey AS VARCHAR(20)) AS appellate_uid, CAST(o_custkey AS VARCHAR(20)) AS district_uid FROM orders WHERE o_orderstatus = 'F'"
_CONFIRMED = "SELECT CAST(o_orderkey AS VARCHAR(20)) AS appellate_uid, 'c' || CAST(o_custkey AS VARCHAR(20)) AS district_uid FROM orders WHERE o_orderpriority = '1-URGENT'"


@query(f"WITH h AS ({_HIGH}), c AS ({_CONFIRMED}) SELECT * FROM c UNION ALL SELECT * FROM h WHERE appellate_uid NOT IN (SELECT appellate_uid FROM c)")
def overwrite_links(spark, sf_dir):
    return relational.overwrite_union(frame(spark, sf_dir, _HIGH), frame(spark, sf_dir, _CONFIRMED), "appellate_uid")


@query(f"WITH h AS ({_HIGH}), n AS (SELECT appellate_uid, district_uid, row_number() OVER (ORDER BY appellate_uid) AS i, count(*) OVER () AS m FROM h) SELECT '\"' || appellate_uid || '\": \"' || district_uid || '\"' || CASE WHEN i < m THEN ',' ELSE '' END AS value FROM n UNION ALL SELECT '{{' UNION ALL SELECT '}}'")
def mapping_save(spark, sf_dir):
    return files.mapping_lines(frame(spark, sf_dir, _HIGH))


@query(f"WITH c AS ({CITES}) SELECT lower(cites_to) AS cite, (max({{'o': cite, 'v': opinion_author_id}})).v AS judge FROM c WHERE cites_to IS NOT NULL GROUP BY 1")
def cited_judges(spark, sf_dir):
    c = cites(spark, sf_dir).select(F.col("cites_to").alias("cite"), "opinion_author_id", F.col("cite").alias("ord"))
    return features.cited_judges(c)


@query(f"WITH j AS ({JUDGES}) SELECT judge_id, last_name FROM j WHERE last_name = 'Supplier#000000004'")
def judge_lookup(spark, sf_dir):
    return features.judges_named(judges(spark, sf_dir), "Supplier#000000004").select("judge_id", "last_name")


@query("WITH RECURSIVE s AS (SELECT doc_id AS ord, strlen(text) AS n_bytes, row_number() OVER (ORDER BY doc_id) AS i FROM documents), f AS (SELECT ord, n_bytes, i, CAST(1 AS BIGINT) AS part, n_bytes AS held FROM s WHERE i = 1 UNION ALL SELECT s.ord, s.n_bytes, s.i, CASE WHEN f.held > 0 AND f.held + s.n_bytes > 100000 THEN f.part + 1 ELSE f.part END, CASE WHEN f.held > 0 AND f.held + s.n_bytes > 100000 THEN s.n_bytes ELSE f.held + s.n_bytes END FROM f JOIN s ON s.i = f.i + 1) SELECT ord, n_bytes, part FROM f")
def request_split(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.octet_length("text").alias("n_bytes"))
    return relational.pack_by_bytes(d, 100_000)


@query("SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c1c2' END AS answer FROM orders")
def response_shapes(spark, sf_dir):
    shapes = F.array(F.lit('{"body":{"choices":[{"message":{"content":"a"}}]}}'), F.lit('{"output_text":"b"}'), F.lit('{"output":[{"content":[{"text":"c1"},{"x":1}]},{"content":[{"text":"c2"}]}]}'))
    return _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), answers.answer_text(F.element_at(shapes, (F.col("o_orderkey") % 3 + 1).cast("int"))).alias("answer"))


_ANSWERS = "SELECT c_custkey AS k, ' ' || upper(n_name) || ' ' AS lower_judge_first, c_mktsegment AS lower_judge_last FROM customer JOIN nation ON c_nationkey = n_nationkey"
_PAIRS = "SELECT c_custkey AS judge_id, c_custkey AS ord, lower(n_name) AS first_name, c_mktsegment AS last_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 5 = 0"


@query(f"WITH a AS ({_ANSWERS}), j AS (SELECT lower(first_name) AS f, lower(last_name) AS l, min(judge_id) AS judge_id FROM ({_PAIRS}) GROUP BY 1, 2) SELECT k, judge_id FROM a LEFT JOIN j ON lower(trim(lower_judge_first)) = f AND lower(trim(lower_judge_last)) = l")
def name_pair_lookup(spark, sf_dir):
    return resolve.ids_from_names(frame(spark, sf_dir, _ANSWERS), frame(spark, sf_dir, _PAIRS)).select("k", "judge_id")


# ---------------------------------------------------------------- extraction and resolution

_OPINIONS = """SELECT o_orderkey AS k, n_name AS court, CASE n_nationkey % 3 WHEN 0 THEN 'Rossi' WHEN 1 THEN 'Alston' ELSE 'Young' END AS judge,
 'Appeal from the United States District Court for the ' || n_name || ', at Asheville.  Jane Q. ' || CASE n_nationkey % 3 WHEN 0 THEN 'Rossi' WHEN 1 THEN 'Alston' ELSE 'Young' END || ', District Judge.' AS opinion_text
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""


@query(f"WITH o AS ({_OPINIONS}) SELECT k, court, judge FROM o")
def judge_extract(spark, sf_dir):
    o = frame(spark, sf_dir, _OPINIONS)
    return o.select("k", courts.extract_court(F.col("opinion_text")).alias("court"), courts.extract_judge(F.col("opinion_text"), "4th").alias("judge"))


_STYLES = {
    "1st": "'[Hon. ' || j || ', U.S. District Judge]'", "2nd": "'No. 12-345, ' || j || ', Judge.'", "3rd": "'District Judge: Hon. ' || j", "4th": "'at Asheville. ' || j || ', District Judge.'",
    "6th": "'No. 12-345 - ' || j || ', District Judge.'", "7th": "'No. 9 - ' || j || ', Magistrate Judge.'", "9th": "'Appeal from the United States District Court for Guam' || chr(10) || j || ', District Judge, Presiding'",
    "5th": "'before ' || chr(10) || j || ', J.' || chr(10) || 'the rest'", "8th": "'District Judge ' || j || '; we'", "10th": "'nobody is named'",
}
_STYLED = "SELECT o_orderkey AS k, circuit, CASE WHEN circuit = '10th' THEN '' ELSE j END AS judge, opinion_text FROM (" + " UNION ALL ".join(
    f"SELECT o_orderkey, '{c}' AS circuit, j, {style} AS opinion_text FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'Jane Rossi' WHEN 1 THEN 'Paul Alston' ELSE 'Ann Young' END AS j FROM orders)" for c, style in _STYLES.items()
) + ")"


@query(_STYLED.replace(", opinion_text FROM (", " FROM (", 1))
def judge_extract_circuits(spark, sf_dir):
    """Every circuit's way to name the judge, and the general ones."""
    o = frame(spark, sf_dir, _STYLED)
    return o.select("k", "circuit", courts.extract_judge(F.col("opinion_text"), F.col("circuit")).alias("judge"))


_RAW = "SELECT o_orderkey AS _cid, 'x v. y' AS name, CAST(o_custkey AS VARCHAR(20)) AS docket_number, o_orderdate AS decision_date, CASE WHEN o_orderkey % 5 = 0 THEN 'no court below is named' WHEN o_orderkey % 5 = 1 THEN 'district judge unknown to us' ELSE 'at Asheville. Ann Lee' || chr(CAST(97 + o_orderkey % 4 AS INT)) || ', District Judge.' END AS opinion_text FROM orders"
_FEW = "SELECT s_suppkey AS judge_id, s_suppkey AS ord, 'Ann' AS first_name, 'Lee' || chr(CAST(97 + s_suppkey AS INT)) AS last_name, 'Court' AS court_name FROM supplier WHERE s_suppkey < 3"


@query(f"SELECT 'CL_' || CAST(_cid AS VARCHAR) AS unique_id, docket_number, 1 AS is_appellate, judge_id AS district_judge_id FROM ({_RAW}) JOIN ({_FEW}) ON _cid % 5 > 1 AND _cid % 4 = judge_id")
def opinions_clean(spark, sf_dir):
    return resolve.clean_opinions(frame(spark, sf_dir, _RAW), frame(spark, sf_dir, _FEW), "4th").select("unique_id", "docket_number", "is_appellate", "district_judge_id")


_GIVEN = "SELECT 'CL_' || CAST(o_orderkey AS VARCHAR(20)) AS custom_id, 'affirmed' AS opinion, ' ann' AS lower_judge_first, 'LEE' || chr(CAST(65 + o_orderkey % 4 AS INT)) AS lower_judge_last FROM orders WHERE o_orderkey % 3 <> 0"
_OPEN = "SELECT 'CL_' || CAST(o_orderkey AS VARCHAR(20)) AS unique_id, 'x v. y' AS name, 'text' AS opinion_text, CAST(o_custkey AS VARCHAR(20)) AS docket_number, o_orderdate AS decision_date FROM orders"


@query(f"SELECT unique_id, docket_number, coalesce(lower(lower_judge_last), '') AS district_judge, judge_id AS district_judge_id, opinion FROM ({_OPEN}) LEFT JOIN ({_GIVEN}) ON unique_id = custom_id LEFT JOIN ({_FEW}) ON lower(lower_judge_last) = lower(last_name)")
def answers_attach_opinions(spark, sf_dir):
    out = answers.attach_to_opinions(frame(spark, sf_dir, _OPEN), frame(spark, sf_dir, _GIVEN), frame(spark, sf_dir, _FEW))
    return out.select("unique_id", "docket_number", "district_judge", "district_judge_id", "opinion")


_LINKED = "SELECT CAST(o_orderkey AS VARCHAR(20)) AS appellate_uid, CAST(o_orderkey + 1 AS VARCHAR(20)) AS district_uid FROM orders WHERE o_orderkey % 50 = 0"
_CAPPED = "SELECT 'CAP_' || CAST(o_orderkey AS VARCHAR(20)) AS custom_id, 'reversed' AS opinion FROM orders WHERE o_orderkey % 100 = 0"


@query(f"WITH v_case AS ({CASES}) SELECT 'CAP_' || CAST(c.unique_id AS VARCHAR) AS unique_id, t.opinion_author_raw AS district_judge, t.opinion_author_id AS district_judge_id, a.opinion FROM v_case c JOIN ({_LINKED}) l ON CAST(c.unique_id AS VARCHAR) = l.appellate_uid LEFT JOIN v_case t ON CAST(t.unique_id AS VARCHAR) = l.district_uid LEFT JOIN ({_CAPPED}) a ON a.custom_id = 'CAP_' || CAST(c.unique_id AS VARCHAR)")
def answers_attach_linked(spark, sf_dir):
    c = cases(spark, sf_dir).withColumn("opinion_author_clean", F.col("opinion_author_raw")).drop("opinion")
    return answers.attach_to_linked(c, frame(spark, sf_dir, _LINKED), frame(spark, sf_dir, _CAPPED)).select("unique_id", "district_judge", "district_judge_id", "opinion")


_BENCH = "SELECT s_suppkey AS judge_id, s_suppkey AS ord, CASE s_suppkey % 3 WHEN 0 THEN 'Ann' WHEN 1 THEN 'Bob M.' ELSE 'Cy' END AS first_name, 'Lee' || chr(CAST(97 + s_suppkey % 13 AS INT)) AS last_name, n_name AS court_name FROM supplier JOIN nation ON s_nationkey = n_nationkey"
_NAMED = "SELECT c_custkey AS case_id, CASE c_custkey % 4 WHEN 0 THEN 'Hon. Ann' WHEN 1 THEN 'Bob' ELSE 'Zed' END || ' Lee' || chr(CAST(97 + c_custkey % 17 AS INT)) AS judge, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE n_name END AS court FROM customer JOIN nation ON c_nationkey = n_nationkey"


@query(f"""WITH j AS (SELECT judge_id AS jid, ord, lower(last_name) AS lk, lower(regexp_extract(first_name, '^[A-Za-z]+')) AS fk, regexp_replace(lower(court_name), '[^a-z]', '', 'g') AS ck FROM ({_BENCH})),
n AS (SELECT case_id, lower(regexp_extract(judge, '[A-Za-z]+$')) AS lk, lower(regexp_extract(replace(judge, 'Hon. ', ''), '^[A-Za-z]+')) AS fk, regexp_replace(lower(court), '[^a-z]', '', 'g') AS ck FROM ({_NAMED})),
p AS (SELECT n.case_id, j.jid, j.ord, n.fk = j.fk AS f, n.ck <> '' AND j.ck <> '' AND (contains(j.ck, n.ck) OR contains(n.ck, j.ck)) AS c FROM n JOIN j ON n.lk = j.lk),
g AS (SELECT case_id, count(*) AS nl, count(*) FILTER (f) AS nf, count(*) FILTER (f AND c) AS nb, count(*) FILTER (c) AS nc, arg_min(jid, ord) AS one, arg_min(jid, ord) FILTER (f) AS bf, arg_min(jid, ord) FILTER (f AND c) AS bb, arg_min(jid, ord) FILTER (c) AS bc FROM p GROUP BY 1)
SELECT n.case_id, n.lk AS district_judge, CASE WHEN nl = 1 THEN one WHEN nf = 1 THEN bf WHEN nf > 1 AND nb >= 1 THEN bb WHEN nc = 1 THEN bc END AS district_judge_id FROM n LEFT JOIN g ON n.case_id = g.case_id""")
def judge_resolve(spark, sf_dir):
    return resolve.resolve_judges(frame(spark, sf_dir, _NAMED), frame(spark, sf_dir, _BENCH)).select("case_id", "district_judge", "district_judge_id")


# ---------------------------------------------------------------- linking

_VEC = f"""v_case AS ({CASES}), c AS (SELECT *, {_LEFT} AS l0, {_RIGHT} AS r0 FROM v_case),
parts AS (SELECT *, l0 <> '' AND r0 <> '' AS sided FROM c),
txt AS (SELECT unique_id, is_appellate, sided, 'W' AS side, {_norm_sql("name")} AS norm FROM parts WHERE is_appellate = 0 OR NOT sided
  UNION ALL SELECT unique_id, is_appellate, sided, 'L', {_norm_sql("l0")} FROM parts WHERE sided UNION ALL SELECT unique_id, is_appellate, sided, 'R', {_norm_sql("r0")} FROM parts WHERE sided),
tok AS (SELECT unique_id, is_appellate, side, CASE WHEN side = 'W' THEN 'W' ELSE 'S' END AS mode, unnest(regexp_extract_all(norm, '\\b\\w\\w+\\b')) AS term FROM txt),
tf AS (SELECT unique_id, is_appellate, side, mode, term, count(*) AS tf FROM tok GROUP BY ALL),
tot AS (SELECT CASE WHEN side = 'W' THEN 'W' ELSE 'S' END AS mode, count(*) AS n FROM txt WHERE is_appellate = 0 GROUP BY 1),
vocab AS (SELECT tf.mode, term, count(*) AS df, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM tf JOIN tot ON tf.mode = tot.mode WHERE is_appellate = 0 GROUP BY tf.mode, term HAVING count(*) <= 0.8 * any_value(n))"""
_LINKS = f"""{_VEC}, raw AS (SELECT tf.*, tf * idf AS w0 FROM tf JOIN vocab USING (mode, term)),
w AS (SELECT *, w0 / sqrt(sum(w0 * w0) OVER (PARTITION BY unique_id, side)) AS w FROM raw),
sim AS (SELECT a.unique_id AS a, d.unique_id AS d, a.side, round(sum(a.w * d.w), 12) AS s FROM w a JOIN w d ON a.side = d.side AND a.term = d.term AND a.is_appellate = 1 AND d.is_appellate = 0
  JOIN v_case ca ON ca.unique_id = a.unique_id JOIN v_case cd ON cd.unique_id = d.unique_id WHERE ca.decision_date IS NULL OR cd.decision_date BETWEEN ca.decision_date - INTERVAL 7 YEAR AND ca.decision_date GROUP BY 1, 2, 3),
pairs AS (SELECT a, d, s AS score, 0.15 AS bonus FROM sim WHERE side = 'W' AND s > 0.65
  UNION ALL SELECT a, d, sum(s) / 2, 0.0 FROM sim WHERE side <> 'W' AND s >= 0.7 GROUP BY a, d HAVING count(*) = 2 AND sum(s) / 2 > 0.65),
links AS (SELECT a, d, score + bonus AS score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, d) AS r FROM pairs) WHERE r = 1)"""
_JUDGE_HIT = "regexp_matches(lower(ta.opinion_text), '\\b' || lower(regexp_extract(td.opinion_author_raw, '^[A-Za-z]+')) || '\\b')"
_ACCEPTED = f"""{_LINKS}, ok AS (SELECT a, d, round(score, 6) AS score, CASE WHEN score >= 0.8 THEN 'high' ELSE 'mid' END AS band,
  CASE WHEN list_has_any(string_split({_dockets_sql(_BLOCK.replace("opinion_text", "ta.opinion_text"))}, '|'), string_split(coalesce({_dockets_sql("td.docket_number")}, ''), '|')) THEN 'docket' WHEN {_JUDGE_HIT} THEN 'judge' END AS confirm_reason
  FROM links JOIN v_case ta ON ta.unique_id = a JOIN v_case td ON td.unique_id = d)"""


@query(f"WITH {_VEC} SELECT mode, term, df, round(idf, 9) AS idf FROM vocab WHERE mode = 'W'")
def tfidf_vocab(spark, sf_dir):
    d = cases(spark, sf_dir).where("is_appellate = 0").withColumn("parts", text.split_caption(F.col("name")))
    norms = similarity.texts(d, False).groupBy("circuit", F.col("norms")[0].alias("norm")).agg(F.count(F.lit(1)).alias("n"))
    return similarity.vocabulary(norms).select(F.lit("W").alias("mode"), "term", "df", F.round("idf", 9).alias("idf"))


@query(f"WITH {_LINKS} SELECT a, d, round(score, 6) AS score FROM links")
def tfidf_link(spark, sf_dir):
    return similarity.link_cases(cases(spark, sf_dir)).select("a", "d", F.round("score", 6).alias("score"))


@query(f"WITH {_ACCEPTED} SELECT a, d, score, band, confirm_reason FROM ok WHERE band = 'high' OR confirm_reason IS NOT NULL")
def link_confirmed(spark, sf_dir):
    return linkage.run_linking(staged(cases(spark, sf_dir), "cases")).select("a", "d", F.round("score", 6).alias("score"), "band", "confirm_reason")


@query(f"WITH {_ACCEPTED} SELECT c.unique_id, CAST(d AS BIGINT) AS district_uid, t.opinion_author_id AS district_judge_id FROM ok JOIN v_case c ON c.unique_id = a JOIN v_case t ON t.unique_id = d WHERE (band = 'high' OR confirm_reason IS NOT NULL) AND t.opinion_author_id IS NOT NULL")
def case_linking(spark, sf_dir):
    c = staged(cases(spark, sf_dir), "cases").withColumn("opinion_author_clean", F.col("opinion_author_raw"))
    return linkage.attach_trial_judge(c, staged(linkage.run_linking(c), "accepted")).select("unique_id", "district_uid", "district_judge_id")
