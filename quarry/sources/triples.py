"""Triples as JSON lines and facts as tab-separated tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.names import escaped
from quarry.operators.triples import PREDICATES, TRIPLE

FIELDS = ["s", "p", "o", "f", "c"]


def checked(lines: DataFrame) -> DataFrame:
    """``lines`` (line_no, value) parsed: the triple's columns and ``error``, null where the line is sound.

    Refused are: no JSON object, missing or further fields, a predicate outside the closed vocabulary. Blank lines are left out.
    """
    parsed = lines.filter(F.trim("value") != "").withColumn("t", F.from_json("value", TRIPLE, {"mode": "PERMISSIVE"})).withColumn("keys", F.json_object_keys("value"))
    known = [p for p, *_ in PREDICATES]
    further = F.array_except("keys", F.array(*map(F.lit, FIELDS)))
    error = (
        F.when(F.col("keys").isNull(), "not a JSON object")
        .when(F.size(further) > 0, F.concat(F.lit("unknown field "), F.array_join(further, ", ")))
        .when((F.size("keys") < 5) | F.exists(F.array(*[F.col(f"t.{f}").cast("string") for f in FIELDS]), lambda x: x.isNull()), "missing field")
        .when(~F.col("t.p").isin(known), F.concat(F.lit("unknown predicate "), F.col("t.p")))
    )
    return parsed.select("line_no", "t.*", error.alias("error"))


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """Lines of one text file with their numbers from 1; a file is read as one row, as line numbers need its start."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("i", "value")).select((F.col("i") + 1).alias("line_no"), "value")


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """Triples of a JSON-lines file; reading fails with the line number of the first bad line met."""
    rows = checked(numbered(spark, path))
    fail = F.raise_error(F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(": "), F.col("error")))
    return rows.filter(F.when(F.col("error").isNotNull(), fail.cast("boolean")).otherwise(F.lit(True))).select(*FIELDS)


def read_folder(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(sound triples, refused lines) of a folder of any size, read split by split; refused lines carry their file, not a number."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.lit(None).cast("int").alias("line_no"))
    rows = checked(lines.select("line_no", "value"))
    return rows.filter("error is null").select(*FIELDS), rows.filter("error is not null").select("error")


def write_triples(triples: DataFrame, path: str) -> None:
    triples.select(*FIELDS).write.json(path)


def rows_text(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows as tab-separated cells, free text escaped, nulls as a dash; a set, sorted with the crate's row first."""
    first = F.when(F.col("predicate") == "CRATE", 0).otherwise(1) if "predicate" in columns else F.lit(1)
    cells = [F.coalesce(escaped(F.col(c).cast("string")), F.lit("-")) for c in columns]
    return rows.select(*columns).distinct().orderBy(first, *columns).select(F.concat_ws("\t", *cells).alias("value"))


def write_rows(rows: DataFrame, columns: list[str], path: str, schema: str, version: int = 1) -> None:
    """A tab-separated table: version and schema lines go to ``_header``, the sorted rows to part files."""
    spark = rows.sparkSession
    rows_text(rows, columns).write.text(f"{path}/rows")
    header = [(0, f"#version {version}"), (1, f"#schema {schema}")]
    spark.createDataFrame(header, "i int, value string").orderBy("i").select("value").coalesce(1).write.text(f"{path}/_header")


def read_rows(spark: SparkSession, path: str, columns: list[str], schema: str, version: int = 1) -> DataFrame:
    """The table again; fails if the header says another version or schema or a row has another number of cells."""
    header = [r.value for r in spark.read.text(f"{path}/_header").limit(3).collect()]
    if header != [f"#version {version}", f"#schema {schema}"]:
        raise ValueError(f"{path}: header {header} is not version {version} of {schema}")
    cells = F.split("value", "\t", -1)
    wrong = F.raise_error(F.concat(F.lit("wrong number of cells: "), "value")).cast("string")
    read = spark.read.text(f"{path}/rows").withColumn("cells", cells)
    value = lambda i: F.when(F.size("cells") != len(columns), wrong).otherwise(F.nullif(F.get("cells", F.lit(i)), F.lit("-")))
    return read.select(*[value(i).alias(c) for i, c in enumerate(columns)])


def receipt(rows: DataFrame, by: str, **facts) -> DataFrame:
    """One row with a JSON receipt: rows by ``by`` and further facts, keys sorted, no time stamp."""
    counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    listed = counts.agg(F.array_sort(F.collect_list(F.struct(F.col(by).alias("key"), F.col("n").alias("value")))).alias("e"))
    fixed = [F.lit(v).alias(k) for k, v in sorted(facts.items())]
    return listed.select(F.to_json(F.struct(F.map_from_entries("e").alias("cardinalities"), *fixed), {"pretty": "true"}).alias("receipt"))


def import_edges(files: DataFrame, column: str = "json") -> DataFrame:
    """Distinct (src, dst) of texts {"file": ["imported", ...]}; a text of another shape fails the job."""
    shape = F.from_json(column, "map<string,array<string>>", {"mode": "FAILFAST"})
    return files.select(F.explode(shape).alias("src", "targets")).select("src", F.explode("targets").alias("dst")).distinct()
