"""File sources and sinks: folders of binary documents, seed files, two-line orbital elements, markdown and JSON (inventory S, D8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DOCUMENTS = "title string, source_url string, source_type string, mission_name string, checksum string, metadata map<string,string>"
CHUNKS = "document_checksum string, content string, embedding array<float>, chunk_index int, section_path string, token_count int, metadata map<string,string>"
SATELLITES = (
    "norad_id int, name string, international_designator string, epoch string, mean_motion double, eccentricity double, inclination double, ra_of_asc_node double, arg_of_pericenter double, "
    "mean_anomaly double, rev_number int, classification string, object_type string, launch_date date, decay_date date, period_minutes double, apoapsis_km double, periapsis_km double, rcs_meters2 double, source string"
)


def scan_folder(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, title, length, checksum) of the files right in folder; titles are file stems. Contents stay on the executors."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", F.regexp_replace(name, r"\.[^.]*$", "").alias("title"), "length", F.sha2("content", 256).alias("checksum"))


def new_files(scanned: DataFrame, known: DataFrame) -> DataFrame:
    """Of scanned, the files whose checksum is not known; of equal ones the first by path."""
    first = scanned.withColumn("__n", F.row_number().over(Window.partitionBy("checksum").orderBy("path"))).filter("__n = 1").drop("__n")
    return first.join(known.select("checksum"), "checksum", "left_anti").select(*scanned.columns)


def seed_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DOCUMENTS).option("multiLine", True).json(path)


def seed_chunks(spark: SparkSession, path: str, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks of known documents, rejected chunks)."""
    chunks = spark.read.schema(CHUNKS).option("multiLine", True).json(path)
    known = documents.select(F.col("checksum").alias("document_checksum")).distinct()
    return chunks.join(known, "document_checksum", "left_semi"), chunks.join(known, "document_checksum", "left_anti")


def seed_satellites(spark: SparkSession, path: str) -> DataFrame:
    """Epochs are ISO texts; one that does not parse gives null."""
    return spark.read.schema(SATELLITES).option("multiLine", True).json(path).withColumn("epoch", F.try_to_timestamp("epoch"))


def read_tle(spark: SparkSession, path: str) -> DataFrame:
    """Satellites of text files of two-line elements with a name line before each pair.

    The three lines follow one another and both element lines hold the same catalogue number. Their order counts,
    so a file is one row while it is split. A record of which a line is missing is dropped.
    """
    files = spark.read.text(path, wholetext=True)
    lines = files.select(F.explode(F.expr(r"regexp_extract_all(value, r'(?m)^([^\n]*)\r?\n(1 [^\n]{60,})\r?\n(2 [^\n]{60,})', 0)")).alias("r")).select(F.split("r", r"\r?\n").alias("x"))
    one, two = F.col("x")[1], F.col("x")[2]

    def number(line, start, length, kind="double"):
        return F.trim(F.substring(line, start, length)).try_cast(kind)

    year = number(one, 19, 2, "int")
    full = year + F.when(year < 57, 2000).otherwise(1900)
    start = F.unix_seconds(F.make_timestamp(full, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0), F.lit("UTC")))
    epoch = F.timestamp_micros(((start + (number(one, 21, 12) - 1) * 86400) * 1_000_000).cast("long"))
    return lines.filter(F.substring(one, 3, 5) == F.substring(two, 3, 5)).select(
        number(one, 3, 5, "int").alias("norad_id"), F.trim(F.col("x")[0]).alias("name"), F.trim(F.substring(one, 10, 8)).alias("international_designator"), epoch.alias("epoch"),
        number(two, 53, 11).alias("mean_motion"), (number(two, 27, 7) / 1e7).alias("eccentricity"), number(two, 9, 8).alias("inclination"), number(two, 18, 8).alias("ra_of_asc_node"),
        number(two, 35, 8).alias("arg_of_pericenter"), number(two, 44, 8).alias("mean_anomaly"), number(two, 64, 5, "int").alias("rev_number"), F.substring(one, 8, 1).alias("classification"), F.lit("tle").alias("source"),
    )


def read_satellites_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SATELLITES).option("header", True).option("enforceSchema", False).csv(path).withColumn("epoch", F.try_to_timestamp("epoch"))


def bulletins_xml(texts: DataFrame, schema: str, column: str = "xml") -> DataFrame:
    """The fields of one XML bulletin a row; a text that is no XML gives nulls."""
    return texts.withColumn("fields", F.from_xml(column, schema)).select(*[c for c in texts.columns if c != column], "fields.*")


def write_markdown(documents: DataFrame, path: str, text: str = "text", by: str = "title") -> None:
    """One folder by=value for each document below path, with its text."""
    documents.select(F.col(text).alias("value"), by).write.partitionBy(by).text(path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    chunks.write.json(path)
