"""Readers and writers of prompts, answers, spans and reports. Paths go to Spark's readers alone, so
any store that Spark reads will do. Writers use Spark's commit protocol: a reader never sees half a
table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PROMPT = "id string, prompt string"
ANSWER = "id string, prompt string, answer string, model string"
#: Cells of a CSV file that count as missing.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def json_array(spark: SparkSession, path, schema: str) -> DataFrame:
    """Files of one JSON array (or object) each; a file is read by one task, as JSON arrays can't be
    split. Write large inputs as lines."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_lines(spark: SparkSession, path, schema: str) -> DataFrame:
    """One object a line; files are split."""
    return spark.read.schema(schema).json(path)


def csv(spark: SparkSession, path) -> DataFrame:
    """Quoted fields may hold line ends; quotes in them are doubled. All columns are strings."""
    return spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)


def dropna(rows: DataFrame, column: str) -> DataFrame:
    """Rows whose cell isn't missing."""
    return rows.where(F.col(column).isNotNull() & ~F.col(column).isin(*MISSING))


def renamed(rows: DataFrame, column: str, *names: str) -> DataFrame:
    """``column`` from the first of ``names`` that the table has."""
    for name in names:
        if name in rows.columns:
            return rows.withColumnRenamed(name, column)
    raise ValueError(f"none of the columns {', '.join(names)} in {', '.join(rows.columns)}")


def _sheet(spark: SparkSession, path) -> DataFrame:
    from .xlsx import read_sheet

    rows = renamed(read_sheet(spark, path), "id", "qid", "id")
    return rows.select("id", "prompt").where("prompt is not null and prompt <> ''")


#: Readers of prompts by extension.
PROMPT_READERS = {
    "json": lambda spark, path: json_array(spark, path, PROMPT),
    "jsonl": lambda spark, path: json_lines(spark, path, PROMPT),
    "csv": lambda spark, path: dropna(csv(spark, path), "prompt"),
    "xlsx": _sheet,
}


def prompts(spark: SparkSession, path: str) -> DataFrame:
    """Prompts by the file's extension, whatever its case; ValueError for others."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind not in PROMPT_READERS:
        raise ValueError(f"no reader of prompts for .{kind} files")
    return PROMPT_READERS[kind](spark, path)


def whole_files(spark: SparkSession, paths) -> DataFrame:
    """(path, value), one row a file."""
    return spark.read.option("wholetext", True).text(paths).select(F.col("_metadata.file_path").alias("path"), "value")


def records(documents: DataFrame, schema: str, wrapped: bool = True) -> DataFrame:
    """The records of JSON documents (column ``value``) beside the other columns: an array's elements;
    an object's ``per_sample`` elements (if ``wrapped``); or else the object itself. Text that isn't
    JSON gives no row."""
    value = F.trim("value")
    listed = F.from_json(F.when(F.startswith(value, F.lit("[")), value), f"array<struct<{schema}>>")
    is_object = F.startswith(value, F.lit("{"))
    inner = F.from_json(F.when(is_object, value), f"per_sample array<struct<{schema}>>")["per_sample"]
    bare = F.array(F.from_json(F.when(is_object, value), f"struct<{schema}>"))
    found = F.coalesce(listed, inner, bare) if wrapped else F.coalesce(listed, bare)
    kept = [c for c in documents.columns if c != "value"]
    valid = F.get_json_object(value, "$").isNotNull()
    return documents.where(valid).select(*kept, F.explode(found).alias("rec")).select(*kept, "rec.*")


def answers(spark: SparkSession, paths, schema: str = ANSWER) -> DataFrame:
    """Answer records of whole files, with the path."""
    return records(whole_files(spark, paths), schema)


def name_of(path: Column, suffix: str) -> Column:
    """The file name without the suffix; null for other files."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.when(F.endswith(name, F.lit(suffix)), F.left(name, F.length(name) - len(suffix)))


def union_of(spark: SparkSession, patterns: list[str], schema: str, stems: set[str] | None = None) -> DataFrame:
    """JSON lines of all files of several globs, with the file's stem; ``stems``: only those files."""
    rows = spark.read.schema(schema).json(patterns).withColumn("stem", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1))
    return rows.where(F.col("stem").isin(*sorted(stems))) if stems is not None else rows


def write_lines(rows: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """JSON lines, a folder for each value of ``by``."""
    rows.write.mode("overwrite").partitionBy(*by).option("ignoreNullFields", False).json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """With a header and without an index; every field quoted, null and empty both empty."""
    rows.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def output_name(model: str, prompt: str = "default", annotator: str | None = None) -> str:
    """File name of a run: model[_prompt].json, or model__annotator_typology.json."""
    if annotator:
        return f"{model}__{annotator}_typology.json"
    return f"{model}.json" if prompt == "default" else f"{model}_{prompt}.json"
