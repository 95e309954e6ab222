"""Diagnostics as text: one line or document per renderer, and graph and fact exports.

Diagnostics have path, row, col, code, severity, message (end_row, end_col where a renderer says so).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def concise(found: DataFrame) -> DataFrame:
    return found.select("path", "row", "col", F.format_string("%s:%d:%d: %s %s", "path", "row", "col", "code", "message").alias("text"))


def pylint(found: DataFrame) -> DataFrame:
    return found.select("path", "row", "col", F.format_string("%s:%d: [%s] %s", "path", "row", "code", "message").alias("text"))


def _github(value: Column, in_property: bool) -> Column:
    text = value
    for raw, written in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A"), *(((":", "%3A"), (",", "%2C")) if in_property else ())):
        text = F.replace(text, F.lit(raw), F.lit(written))
    return text


def github(found: DataFrame) -> DataFrame:
    level = F.when(F.col("severity").isin("info", "help"), "notice").when(F.col("severity") == "warning", "warning").otherwise("error")
    line = F.format_string("::%s title=%s,file=%s,line=%d,col=%d::%s", level, _github(F.col("code"), True), _github(F.col("path"), True), "row", "col", _github(F.col("message"), False))
    return found.select("path", "row", "col", line.alias("text"))


def azure(found: DataFrame) -> DataFrame:
    level = F.when(F.col("severity").isin("info", "warning", "help"), "warning").otherwise("error")
    line = F.format_string("##vso[task.logissue type=%s;sourcepath=%s;linenumber=%d;columnnumber=%d;code=%s;]%s", level, "path", "row", "col", "code", "message")
    return found.select("path", "row", "col", line.alias("text"))


def json_lines(found: DataFrame) -> DataFrame:
    record = F.struct("code", F.col("path").alias("filename"), F.struct(F.col("row"), F.col("col").alias("column")).alias("location"), "message", "severity")
    return found.select("path", "row", "col", F.to_json(record).alias("text"))


def gitlab(found: DataFrame) -> DataFrame:
    """With a fingerprint that stays when lines move; equal findings of a file are told apart by their order."""
    same = Window.partitionBy("path", "code", "message").orderBy("row", "col")
    print_ = F.sha2(F.concat_ws("\x1f", "path", "code", "message", F.row_number().over(same).cast("string")), 256)
    severity = F.when(F.col("severity") == "error", "major").when(F.col("severity") == "warning", "minor").otherwise("info")
    numbered = found.withColumn("fingerprint", print_)
    place = F.struct(F.col("path"), F.struct(F.struct(F.col("row").alias("line"), F.col("col").alias("column")).alias("begin")).alias("positions"))
    record = F.struct(F.col("code").alias("check_name"), F.col("message").alias("description"), severity.alias("severity"), "fingerprint", place.alias("location"))
    return numbered.select("path", "row", "col", "fingerprint", F.to_json(record).alias("text"))


def rdjson(found: DataFrame) -> DataFrame:
    spot = F.struct(F.struct(F.struct(F.col("row").alias("line"), F.col("col").alias("column")).alias("start")).alias("range"), "path")
    record = F.struct(F.struct(F.col("code").alias("value")).alias("code"), spot.alias("location"), "message", F.upper("severity").alias("severity"))
    return found.select("path", "row", "col", F.to_json(record).alias("text"))


def _xml(value: Column) -> Column:
    text = value
    for raw, written in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(written))
    return text


def junit(found: DataFrame) -> DataFrame:
    """One test suite element per file with its cases in order."""
    case = F.format_string('<testcase name="%s" line="%d" column="%d"><failure message="%s"/></testcase>', _xml(F.col("code")), "row", "col", _xml(F.col("message")))
    cases = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "col", case.alias("case")))), lambda x: x["case"]), "")
    suites = found.groupBy("path").agg(F.count(F.lit(1)).alias("n"), cases.alias("cases"))
    return suites.select("path", F.format_string('<testsuite name="%s" tests="%d">%s</testsuite>', _xml(F.col("path")), "n", "cases").alias("text"))


def grouped(found: DataFrame) -> DataFrame:
    """Lines under each file, row and column padded to the widest of the file."""
    window = Window.partitionBy("path")
    pad = lambda c: F.length(F.max(F.col(c)).over(window).cast("string"))
    wide = found.withColumn("row_width", pad("row")).withColumn("col_width", pad("col"))
    text = F.concat(F.expr("lpad(cast(row as string), row_width, ' ')"), F.lit(":"), F.expr("rpad(cast(col as string), col_width, ' ')"), F.lit(" "), "code", F.lit(" "), "message")
    return wide.select("path", "row", "col", text.alias("text"))


def mermaid(edges: DataFrame, graph: str) -> DataFrame:
    """Per graph the text of a flow chart with its edges in order; a graph is one function's control flow."""
    line = F.concat(F.lit("    "), F.col("src").cast("string"), F.lit(" --> "), F.col("dst").cast("string"))
    body = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("src", "dst", line.alias("line")))), lambda x: x["line"]), "\n")
    return edges.groupBy(graph).agg(F.concat(F.lit("graph TD\n"), body).alias("text"))


def kythe(facts: DataFrame) -> DataFrame:
    """Graph-store entries as JSON: node signature, fact name and base64 value."""
    entry = F.concat(
        F.lit('{"source":{"corpus":"'), "corpus", F.lit('","signature":"'), "signature", F.lit('"},"fact_name":"/'), "fact", F.lit('","fact_value":"'),
        F.base64(F.col("value").cast("binary")), F.lit('"}'),
    )
    return facts.select("signature", "fact", entry.alias("entry"))


def struct_text(fields: DataFrame, owner: str) -> DataFrame:
    """Per owner the text of a record type: its fields (pos, name, kind) in order."""
    line = F.concat(F.lit("    pub "), "name", F.lit(": "), "kind", F.lit(","))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "\n")
    return fields.groupBy(owner).agg(F.concat(F.lit("pub struct "), F.col(owner), F.lit(" {\n"), body, F.lit("\n}")).alias("text"))
