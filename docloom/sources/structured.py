"""Delimited, JSON-lines and JSON ingest with profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Patterns of a date and of numbers in delimited text.
DATE = r"^(\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}-\d{2}-\d{4}|\d{4}/\d{2}/\d{2})$"
INTEGER = r"^[+-]?\d+$"
FLOAT = r"(?i)^[+-]?(\d+\.?\d*([e][+-]?\d+)?|\.\d+([e][+-]?\d+)?|inf|infinity|nan)$"


DELIMITERS = [",", "\t", ";", "|"]


def detect_delimiters(spark: SparkSession, path: str) -> DataFrame:
    """path, delimiter for each file: TAB for .tsv and .tab, else the one whose number per line varies least.

    Counted over all lines of a file in one aggregation; a comma where nothing is found.
    """
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.col("_metadata.file_path").alias("path"), "value")
    number = [F.length("value") - F.length(F.replace("value", F.lit(d), F.lit(""))) for d in DELIMITERS]
    seen = lines.groupBy("path").agg(*[x for i, c in enumerate(number) for x in (F.avg(c).alias(f"m{i}"), F.stddev_pop(c).alias(f"s{i}"))])
    steady = F.array(*[F.when(F.col(f"m{i}") > 0, F.struct((-F.col(f"s{i}") / F.col(f"m{i}")).alias("r"), F.col(f"m{i}").alias("m"), F.lit(d).alias("d"))) for i, d in enumerate(DELIMITERS)])
    by_name = F.lower("path").rlike(r"\.(tsv|tab)$")
    return seen.select("path", F.when(by_name, "\t").otherwise(F.coalesce(F.array_max(F.array_compact(steady))["d"], F.lit(","))).alias("delimiter"))


def read_delimited(spark: SparkSession, path: str, delimiter: str | None = None, quote: str = '"', escape: str = '"', multi_line: bool = False, encoding: str = "UTF-8") -> DataFrame:
    """All columns as strings, empty strings as NULL. Each file is read with its own delimiter unless one is given.

    Doubled quotes stand for one; ``multi_line`` lets quoted cells hold line breaks.
    """
    if delimiter:
        groups = {delimiter: [path]}
    else:
        groups = {}
        for r in detect_delimiters(spark, path).orderBy("path").collect():  # one row per file
            groups.setdefault(r["delimiter"], []).append(r["path"])
    out = None
    for sep, paths in (groups or {",": [path]}).items():
        one = spark.read.csv(paths, sep=sep, header=True, quote=quote, escape=escape, multiLine=multi_line, encoding=encoding, emptyValue="", nullValue="")
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def column_types(rows: DataFrame) -> DataFrame:
    """Type of every column: string beats date beats float beats integer; unknown if all empty.

    One aggregation over the rows, then one row per column; nothing is stacked per cell.
    """
    def cell(c: str) -> Column:
        return F.col("`" + c.replace("`", "``") + "`")

    def kind(c: str) -> Column:
        v = F.trim(cell(c))
        return F.when(v == "", None).when(v.rlike(INTEGER), 1).when(v.rlike(FLOAT), 2).when(v.rlike(DATE), 3).when(v.isNotNull(), 4)

    # Positions name the results, so no column name can clash with them.
    numbered = list(enumerate(rows.columns))
    highest = rows.agg(*[F.max(kind(c)).alias(f"k{i}") for i, c in numbered], *[F.count(cell(c)).alias(f"n{i}") for i, c in numbered])
    name = lambda c: F.when(c == 4, "string").when(c == 3, "date").when(c == 2, "float").when(c == 1, "integer").otherwise("unknown")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), name(F.col(f"k{i}")).alias("type"), F.col(f"n{i}").alias("n_values")) for i, c in numbered])
    return highest.select(F.explode(cells).alias("c")).select("c.*")


def json_lines(lines: DataFrame, group: str) -> DataFrame:
    """Line, record and error counts per file with the file's confidence.

    ``lines(value, <group>)``; blank lines do not count. Confidence is .95 without errors, else
    one minus the error share, at least .5.
    """
    seen = lines.where(F.trim("value") != "").withColumn("ok", F.try_parse_json("value").isNotNull())
    counts = seen.groupBy(group).agg(F.count("*").alias("n_lines"), F.count_if("ok").alias("n_records"), F.count_if(~F.col("ok")).alias("n_errors"))
    share = F.col("n_errors") / F.greatest(F.col("n_lines"), F.lit(1))
    return counts.withColumn("confidence", F.when(F.col("n_errors") == 0, 0.95).otherwise(F.greatest(F.lit(0.5), 1.0 - share)))


def key_types(records: DataFrame, column: str = "json") -> DataFrame:
    """Sorted, pipe-joined JSON types seen per top-level key. Invalid records are skipped."""
    parsed = records.select(F.try_parse_json(column).alias("v")).where(F.col("v").isNotNull())
    cells = parsed.lateralJoin(parsed.sparkSession.tvf.variant_explode(F.col("v").outer())).select(
        "key", F.schema_of_variant("value").alias("t"))
    t = F.col("t")
    kind = (
        F.when(t == "VOID", "null").when(t == "BOOLEAN", "boolean").when(t == "BIGINT", "integer")
        .when(t.startswith("DECIMAL") | t.isin("DOUBLE", "FLOAT"), "float").when(t == "STRING", "string")
        .when(t.startswith("ARRAY"), "array").when(t.startswith("OBJECT"), "object").otherwise("string")
    )
    return cells.groupBy("key", kind.alias("kind")).agg(F.count("*").alias("n")).groupBy("key").agg(
        F.array_join(F.array_sort(F.collect_list("kind")), "|").alias("types"), F.sum("n").alias("n_values"))
