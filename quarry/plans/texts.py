"""Line, text and report queries on documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import lines, reports
from quarry.plans.base import query, table

LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents)"


def _lines(spark, sf):
    return lines.split_lines(table(spark, sf, "documents"), "doc_id", "text")


@query(f"""WITH {LINES}, w AS (SELECT *, list_filter(string_split(trim(line), ' '), lambda x: x <> '') AS w FROM l)
SELECT doc_id, line_no, length(line)::INT AS width FROM w WHERE length(line) > 320 AND len(w) > 1 AND NOT (len(w) = 2 AND w[1] IN ('#', '//')) AND NOT contains(w[-1], '://')""")
def line_too_long(spark, sf):
    return lines.too_long(_lines(spark, sf), 320).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "width")


@query("SELECT doc_id FROM documents WHERE text <> '' AND NOT ends_with(text, chr(10))")
def no_newline_eof(spark, sf):
    return lines.without_final_newline(table(spark, sf, "documents"), "doc_id", "text")


@query("WITH h AS (SELECT page_id, replace(html, '>', '> ') AS html FROM pages), l AS (SELECT page_id, unnest(string_split(html, chr(10))) AS line, unnest(range(1, len(string_split(html, chr(10))) + 1)) AS line_no FROM h) SELECT page_id, line_no, regexp_matches(line, '^[ \\t]+$') AS blank FROM l WHERE regexp_matches(line, '[ \\t\\f\\x0b]$')")
def trailing_whitespace(spark, sf):
    """Lines of pages that end in a blank, with one set behind every tag."""
    pages = table(spark, sf, "pages").withColumn("html", F.replace("html", F.lit(">"), F.lit("> ")))
    found = lines.trailing_space(lines.split_lines(pages, "page_id", "html"))
    return found.select("page_id", F.col("line_no").cast("long").alias("line_no"), "blank")


@query(f"WITH {LINES} SELECT doc_id, line_no FROM l WHERE regexp_matches(line, '{lines.SECRET.replace(chr(39), chr(39) * 2)}')")
def hardcoded_secret(spark, sf):
    return lines.matching(_lines(spark, sf), lines.SECRET).select("doc_id", F.col("line_no").cast("long").alias("line_no"))


@query(f"WITH {LINES} SELECT doc_id, line_no, regexp_extract(line, '{lines.ADDRESS}') AS hit FROM l WHERE regexp_matches(line, '{lines.ADDRESS}')")
def hardcoded_ip(spark, sf):
    return lines.matching(_lines(spark, sf), lines.ADDRESS).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "hit")


@query(f"WITH {LINES} SELECT doc_id, line_no, instr(line, '#') - 1 AS col, substr(line, instr(line, '#')) AS comment, trim(substr(line, 1, instr(line, '#') - 1), ' ') = '' AS own_line FROM l WHERE contains(line, '#')")
def comment_ranges(spark, sf):
    found = lines.comments(_lines(spark, sf))
    return found.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("col").cast("long").alias("col"), "comment", "own_line")


@query("SELECT doc_id, regexp_matches(substr(text, 1, 4096), '(?i)licen[sc]e') AS has_notice FROM documents")
def license_notice(spark, sf):
    return table(spark, sf, "documents").select("doc_id", lines.has_notice(F.col("text"), "(?i)licen[sc]e").alias("has_notice"))


@query(f"WITH {LINES} SELECT doc_id, line_no FROM l WHERE regexp_matches(line, '[^\\x00-\\x7F]')")
def non_ascii_lines(spark, sf):
    return lines.matching(_lines(spark, sf), r"[^\x00-\x7F]").select("doc_id", F.col("line_no").cast("long").alias("line_no"))


_FROM, _TO = "".join(lines.CONFUSABLE), "".join(lines.CONFUSABLE.values()).replace("'", "''")


@query(f"WITH l AS (SELECT page_id, unnest(string_split(html, '</p>')) AS line FROM pages), x AS (SELECT page_id, replace(line, 'oft', '‘–') AS line FROM l) SELECT page_id, line, (length(line) - length(translate(line, '{_FROM}', '')))::INT AS n, translate(line, '{_FROM}', '{_TO}') AS fixed FROM x WHERE n > 0")
def ambiguous_chars(spark, sf):
    """Paragraphs of pages into which confusable characters were put, for the tables have few."""
    parts = table(spark, sf, "pages").select("page_id", F.explode(F.split("html", "</p>")).alias("line"))
    return lines.ambiguous(parts.withColumn("line", F.replace("line", F.lit("oft"), F.lit("‘–"))))


FOUND = f"""{LINES}, f AS (SELECT doc_id, 'src/' || doc_id || '.txt' AS path, line_no AS row, instr(line, '#') AS col, CASE WHEN length(line) > 320 THEN 'E501' ELSE 'C001' END AS code,
CASE WHEN length(line) > 320 THEN 'error' ELSE 'warning' END AS severity, 'found ' || length(line) AS message FROM l WHERE contains(line, '#'))"""


def _found(spark, sf):
    """Lines with a number sign as diagnostics."""
    of = _lines(spark, sf).filter(F.contains("line", F.lit("#")))
    long = F.length("line") > 320
    return of.select(
        F.concat(F.lit("src/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("line_no").alias("row"), F.locate("#", F.col("line")).alias("col"),
        F.when(long, "E501").otherwise("C001").alias("code"), F.when(long, "error").otherwise("warning").alias("severity"), F.concat(F.lit("found "), F.length("line").cast("string")).alias("message"),
    )


def _texts(rendered):
    return rendered.select("path", "text")


@query(f"WITH {FOUND} SELECT path, path || ':' || row || ':' || col || ': ' || code || ' ' || message AS text FROM f")
def concise_report(spark, sf):
    return _texts(reports.concise(_found(spark, sf)))


@query(f"WITH {FOUND} SELECT path, path || ':' || row || ': [' || code || '] ' || message AS text FROM f")
def pylint_report(spark, sf):
    return _texts(reports.pylint(_found(spark, sf)))


@query(f"WITH {FOUND} SELECT path, '::' || severity || ' title=' || code || ',file=' || path || ',line=' || row || ',col=' || col || '::' || message AS text FROM f")
def github_report(spark, sf):
    return _texts(reports.github(_found(spark, sf)))


@query(f"WITH {FOUND} SELECT path, '##vso[task.logissue type=' || severity || ';sourcepath=' || path || ';linenumber=' || row || ';columnnumber=' || col || ';code=' || code || ';]' || message AS text FROM f")
def azure_report(spark, sf):
    return _texts(reports.azure(_found(spark, sf)))


@query(f"""WITH {FOUND} SELECT path, '{{"code":"' || code || '","filename":"' || path || '","location":{{"row":' || row || ',"column":' || col || '}},"message":"' || message || '","severity":"' || severity || '"}}' AS text FROM f""")
def json_lines_report(spark, sf):
    return _texts(reports.json_lines(_found(spark, sf)))


@query(f"""WITH {FOUND} SELECT path, '{{"code":{{"value":"' || code || '"}},"location":{{"range":{{"start":{{"line":' || row || ',"column":' || col || '}}}},"path":"' || path || '"}},"message":"' || message || '","severity":"' || upper(severity) || '"}}' AS text FROM f""")
def rdjson_report(spark, sf):
    return _texts(reports.rdjson(_found(spark, sf)))


@query(f"""WITH {FOUND}, g AS (SELECT *, sha256(path || chr(31) || code || chr(31) || message || chr(31) || row_number() OVER (PARTITION BY path, code, message ORDER BY row, col)) AS fingerprint FROM f)
SELECT path, row, fingerprint FROM g""")
def gitlab_fingerprints(spark, sf):
    return reports.gitlab(_found(spark, sf)).select("path", F.col("row").cast("long").alias("row"), "fingerprint")


@query(f"""WITH {FOUND} SELECT path, '<testsuite name="' || path || '" tests="' || count(*) || '">' || string_agg('<testcase name="' || code || '" line="' || row || '" column="' || col || '"><failure message="' || message || '"/></testcase>', '' ORDER BY row, col) || '</testsuite>' AS text FROM f GROUP BY path""")
def junit_report(spark, sf):
    return reports.junit(_found(spark, sf))


@query(f"""WITH {FOUND}, w AS (SELECT *, max(length(row::VARCHAR)) OVER (PARTITION BY path) AS rw, max(length(col::VARCHAR)) OVER (PARTITION BY path) AS cw FROM f)
SELECT path, lpad(row::VARCHAR, rw::INT, ' ') || ':' || rpad(col::VARCHAR, cw::INT, ' ') || ' ' || code || ' ' || message AS text FROM w""")
def grouped_report(spark, sf):
    return _texts(reports.grouped(_found(spark, sf)))


IGNORES = [("%src0%", "E501"), ("%src1%", "C001"), ("%src2", "E501")]


@query(f"""WITH {FOUND}, i(pattern, code) AS (VALUES {", ".join(f"('{p}', '{c}')" for p, c in IGNORES)}), d AS (SELECT f.*, source FROM f JOIN documents USING (doc_id))
SELECT path, row, d.code FROM d WHERE NOT EXISTS (SELECT 1 FROM i WHERE d.source LIKE i.pattern AND d.code = i.code)""")
def per_file_ignores(spark, sf):
    """Findings but for those whose file's pattern switches their code off."""
    found = _found(spark, sf).withColumn("doc_id", F.regexp_extract("path", r"(\d+)", 1).cast("long"))
    placed = found.join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    off = F.lit(False)
    for pattern, code in IGNORES:
        off = off | (F.col("source").like(pattern) & (F.col("code") == code))
    return placed.filter(~off).select("path", F.col("row").cast("long").alias("row"), "code")


@query(f"WITH {LINES}, s AS (SELECT DISTINCT doc_id FROM l WHERE contains(line, '#')) SELECT doc_id FROM labels ANTI JOIN s USING (doc_id) WHERE quality = 0")
def suppression_unused(spark, sf):
    """Suppressions (documents marked low) that no finding uses."""
    found = _found(spark, sf).select(F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("doc_id")).distinct()
    return table(spark, sf, "labels").filter("quality = 0").select("doc_id").join(found, "doc_id", "left_anti")
