"""File sources and sinks of opinions, mappings, requests and answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import norm_id, strip
from ..operators.relational import pack_by_bytes, priority_dedupe

CASE_SCHEMA = (
    "court_name string, name string, decision_date timestamp, docket_number string, opinion_type string, opinion_text string, "
    "opinion_author_raw string, opinion_author_clean string, opinion_author_id long, cite string, cites_to array<string>"
)

# Courts of each circuit (appellate, district).
CIRCUITS: dict[str, tuple[list[str], list[str]]] = {
    "1st": (["First Circuit"], ["Maine", "Massachusetts", "New Hampshire", "Puerto Rico", "Rhode Island"]),
    "2nd": (["Second Circuit"], ["Connecticut", "New York", "Vermont"]),
    "3rd": (["Third Circuit"], ["Delaware", "New Jersey", "Pennsylvania", "Virgin Islands"]),
    "4th": (["Fourth Circuit"], ["Maryland", "North Carolina", "South Carolina", "Virginia", "West Virginia"]),
    "5th": (["Fifth Circuit"], ["Louisiana", "Mississippi", "Texas"]),
    "6th": (["Sixth Circuit"], ["Kentucky", "Michigan", "Ohio", "Tennessee"]),
    "7th": (["Seventh Circuit"], ["Illinois", "Indiana", "Wisconsin"]),
    "8th": (["Eighth Circuit"], ["Arkansas", "Iowa", "Minnesota", "Missouri", "Nebraska", "North Dakota", "South Dakota"]),
    "9th": (["Ninth Circuit"], ["Alaska", "Arizona", "California", "Hawaii", "Idaho", "Montana", "Nevada", "Oregon", "Washington", "Guam", "Northern Mariana Islands"]),
    "10th": (["Tenth Circuit"], ["Colorado", "Kansas", "New Mexico", "Oklahoma", "Utah", "Wyoming"]),
    "11th": (["Eleventh Circuit"], ["Alabama", "Florida", "Georgia"]),
    "dc": (["D.C. Circuit"], ["District of Columbia"]),
}


def circuits() -> list[str]:
    return list(CIRCUITS)


def circuit_table(spark: SparkSession) -> DataFrame:
    """``(circuit, kind, court_pattern)``: a fixed dimension."""
    rows = [(c, kind, p) for c, pair in CIRCUITS.items() for kind, ps in zip(("appellate", "district"), pair, strict=True) for p in ps]
    return spark.createDataFrame(rows, "circuit string, kind string, court_pattern string")


def court_filter(cases: DataFrame, courts: list[str] | None, exact: bool = False) -> DataFrame:
    """Cases whose court name contains (or equals) one of the names, in any case; None keeps all."""
    if courts is None:
        return cases
    name = F.lower("court_name")
    hits = [name == c.lower() if exact else name.contains(c.lower()) for c in courts]
    return cases.where(reduce(lambda a, b: a | b, hits, F.lit(False)))


def appellate_flag(court):
    return F.coalesce(F.lower(court).contains("appeals"), F.lit(False)).cast("int")


def in_circuits(cases: DataFrame, chosen: list[str], exact: bool = False) -> DataFrame:
    """Cases with the ``circuit`` whose courts they name, from one scan; a case that fits several is in each of them."""
    name = F.lower("court_name")
    hit = lambda c: name == c.lower() if exact else name.contains(c.lower())
    fits = [F.when(reduce(lambda a, b: a | b, (hit(c) for part in CIRCUITS[k] for c in part)), F.lit(k)) for k in chosen]
    return cases.withColumn("circuit", F.explode(F.array_compact(F.array(*fits))))


def read_cases(spark: SparkSession, path: str, circuit: str | list[str] | None = None, exact: bool = False) -> DataFrame:
    """Cases of one or several circuits from parquet files, with ids, flag and one appellate case per docket and circuit.

    None reads all courts as the circuit 'all'.  ``ord`` follows file and row position, taken from
    the scan itself: no sort and no shuffle.
    """
    chosen = [circuit] if isinstance(circuit, str) else circuit
    scan = spark.read.schema(CASE_SCHEMA).parquet(path).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    place = F.struct("_file", "_row")
    cases = (scan.withColumn("circuit", F.lit("all")) if chosen is None else in_circuits(scan, chosen, exact)).withColumns({"ord": place, "unique_id": F.sha2(F.concat_ws("#", "_file", "_row"), 224), "is_appellate": appellate_flag(F.col("court_name"))})
    return priority_dedupe(cases, keys=("circuit", "docket_number")).drop("_file", "_row")


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(target)


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """CSV with a header; quoted fields may hold line breaks."""
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def saved_ids(spark: SparkSession, path: str, column: str) -> DataFrame:
    """Distinct ids stored in one column of a CSV or JSON-lines file or a parquet table, as text; a missing file has none."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"`{column}` string")
    if path.endswith((".json", ".jsonl")):
        rows = read_jsonl(spark, path, f"struct<`{column}`:string>")
    else:
        rows = read_csv(spark, path) if path.endswith(".csv") else spark.read.parquet(path)
    return rows.select(F.col(column).cast("string").alias(column)).where(F.col(column).isNotNull()).distinct()


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of a JSON-lines file; blank lines are skipped, a missing file is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    lines = spark.read.text(path).where(strip(F.col("value")) != "")
    return lines.select(F.from_json("value", schema if isinstance(schema, str) else schema.simpleString()).alias("r")).select("r.*")


def mapping_rows(objects: DataFrame, column: str = "value") -> DataFrame:
    """``(appellate_uid, district_uid)`` of JSON objects; ids normalised, empty ones dropped."""
    pairs = objects.select(F.explode(F.from_json(column, "map<string,string>")).alias("k", "v"))
    return pairs.select(norm_id(F.col("k")).alias("appellate_uid"), norm_id(F.col("v")).alias("district_uid")).where("appellate_uid <> '' and district_uid <> ''")


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """Mapping file (one JSON object); a missing file is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], "appellate_uid string, district_uid string")
    return mapping_rows(spark.read.text(path, wholetext=True))


def mapping_lines(links: DataFrame) -> DataFrame:
    """The lines of one JSON object of all links ``(appellate_uid, district_uid)``, one pair a line.

    Links are one row per appellate case; they pass through a single sorted stream and are not held.
    """

    def lines(batches):
        import json

        import pyarrow as pa

        held = None
        yield pa.RecordBatch.from_arrays([pa.array(["{"])], ["value"])
        for batch in batches:
            for a, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([held + ","])], ["value"])
                held = f"{json.dumps(a, ensure_ascii=False)}: {json.dumps(d, ensure_ascii=False)}"
        yield pa.RecordBatch.from_arrays([pa.array(([held] if held is not None else []) + ["}"])], ["value"])

    pairs = links.select(F.col("appellate_uid").cast("string"), F.col("district_uid").cast("string")).dropna().dropDuplicates(["appellate_uid"])
    return pairs.repartition(1).sortWithinPartitions("appellate_uid").mapInArrow(lines, "value string")


def write_mapping(links: DataFrame, path: str) -> None:
    """The mapping as one JSON object in one file, as ``read_mapping`` reads it."""
    mapping_lines(links).write.mode("overwrite").text(path)


def write_parts(requests: DataFrame, path: str, cap: int = 200 << 20, order: str = "ord") -> None:
    """Request lines ``(ord, value)`` as files of at most ``cap`` bytes, a folder ``part=<n>`` each, in order.

    Sizes are packed first; then every part is written by a task of its own.
    """
    sized = requests.select(order, (F.octet_length("value") + 1).alias("n_bytes"))  # with the line break
    parts = pack_by_bytes(sized, cap, order).select(order, "part")
    numbered = requests.select(F.col(order).cast("long").alias(order), "value").join(parts, order)
    numbered.repartition("part").sortWithinPartitions("part", order).select("part", "value").write.mode("overwrite").partitionBy("part").text(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "append") -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode(mode).text(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def stage(spark: SparkSession, path: str, make, partition_by: list[str] | None = None, resume: bool = True) -> DataFrame:
    """The table at ``path``; made and written first unless it is complete already."""
    if not (resume and exists(spark, f"{path}/_SUCCESS")):
        writer = make().write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.parquet(path)
