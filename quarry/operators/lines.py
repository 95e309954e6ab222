"""Line and text checks over (path, text) relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.names import display_width, is_pragma
from quarry.operators.rel import islands

#: Characters easily taken for an ASCII one, and that one. Fixed values.
CONFUSABLE = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "−": "-", "×": "x", "\u00a0": " ", "´": "`", "…": "."}
#: Characters that change the direction of text, and other control characters that hide.
BIDI = "[\u202a-\u202e\u2066-\u2069\u200f\u061c]"
INVISIBLE = "[\x08\x1a\x1b\x00\u200b]"

SECRET = r"""(?i)(pass(word|wd)?|secret|token|api_?key|access_?key)["']?\s*[:=]\s*["'][^"'\s]{4,}["']"""
ALL_INTERFACES = r"\b0[.]0[.]0[.]0\b"
ADDRESS = r"\b([0-9]{1,3}[.]){3}[0-9]{1,3}\b"
SQL_TEXT = r"(?i)\b(select\s.*\sfrom\s|delete\s+from\s|insert\s+into\s.*\s(values|select)\b|update\s.*\sset\s)"
TASK_TAG = r"\b(TODO|FIXME|XXX|HACK|BUG)\b"
COPYRIGHT = r"(?i)copyright\s+((?:\(c\)|©)\s+)?((\d{4}|present)(-(\d{4}|present))*)"


#: Lines of which the running sum of lengths is built in one go; a text's sums cost lines times RUN at most, and its runs are few.
RUN = 128


def _running(sizes: str) -> Column:
    """The sums of what stands before each member of an array of bigints, run by run, so that no array is copied once per member of a long text."""
    whole = F.expr(f"transform(sequence(0, cast((size({sizes}) - 1) div {RUN} as int)), j -> transform(sequence(j * {RUN} + 1, least(size({sizes}), (j + 1) * {RUN})), i -> element_at({sizes}, i)))")
    before = F.reduce(whole, F.array(F.lit(0).cast("long")), lambda a, run: F.array_append(a, F.element_at(a, -1) + F.reduce(run, F.lit(0).cast("long"), lambda x, y: x + y)))
    inside = F.zip_with(whole, before, lambda run, base: F.when(run.isNotNull(), F.reduce(run, F.array(base), lambda a, x: F.array_append(a, F.element_at(a, -1) + x), lambda a: F.slice(a, 1, F.size(run)))))
    return F.flatten(F.filter(inside, lambda x: x.isNotNull()))


def lines(files: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(key, line_no from 1, start as a byte offset, line, last) of every text; a final line feed opens no further line.

    Offsets are summed inside the row, without a shuffle, and so each of several texts of one key has its own.
    """
    parts = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")
    cut = files.filter(F.col(text).isNotNull()).select(key, parts.alias("parts"))
    # The number of lines is taken below the generator, which would otherwise copy all parts into each of its rows.
    sized = cut.select(key, "parts", F.size("parts").alias("n"), F.transform("parts", lambda x: F.octet_length(x).cast("long") + 1).alias("sizes"))
    each = sized.select(key, "n", F.posexplode(F.arrays_zip("parts", _running("sizes").alias("starts"))).alias("i", "one"))
    kept = each.select(key, "i", "n", F.col("one.parts").alias("line"), F.col("one.starts").alias("start")).filter("i < n - 1 or line <> ''")
    return kept.select(key, (F.col("i") + 1).alias("line_no"), "start", "line", (F.col("i") == F.col("n") - 1).alias("last"))


def split_lines(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line): the pieces between line feeds, without offsets and so without a shuffle."""
    return files.select(key, F.posexplode(F.split(text, "\n", -1)).alias("i", "line")).select(key, (F.col("i") + 1).alias("line_no"), "line")


def too_long(of: DataFrame, limit: int) -> DataFrame:
    """Lines wider than ``limit`` characters that are neither one word nor end in an address."""
    words = F.split(F.trim("line"), " +")
    excused = (F.size(words) <= 1) | ((F.size(words) == 2) & F.element_at(words, 1).isin("#", "//")) | F.element_at(words, -1).contains("://")
    return of.filter((F.length("line") > limit) & ~excused).withColumn("width", F.length("line"))


def too_wide(of: DataFrame, limit: int) -> DataFrame:
    """Lines that take more than ``limit`` columns on screen; only lines whose bytes exceed the limit are measured."""
    return of.filter((F.octet_length("line") > limit) | F.contains("line", F.lit("\t"))).withColumn("width", display_width(F.col("line"))).filter(F.col("width") > limit)


def without_final_newline(files: DataFrame, key: str, text: str) -> DataFrame:
    return files.filter((F.col(text) != "") & ~F.col(text).endswith("\n")).select(key)


def trailing_space(of: DataFrame) -> DataFrame:
    """Lines that end in blanks; ``blank`` says whether nothing else is on them."""
    return of.filter(F.col("line").rlike(r"[ \t\f\x0b]$")).withColumn("blank", F.trim("line") == "")


def matching(of: DataFrame, pattern: str, column: str = "line") -> DataFrame:
    """Rows whose text holds a pattern, with the first hit."""
    return of.filter(F.col(column).rlike(pattern)).withColumn("hit", F.regexp_extract(column, pattern, 0))


def has_notice(text: Column, pattern: str, within: int = 4096, least: int = 0) -> Column:
    """Whether a notice stands in the first characters; texts shorter than ``least`` need none."""
    return (F.length(text) < least) | F.substring(text, 1, within).rlike(pattern)


def ambiguous(of: DataFrame, column: str = "line") -> DataFrame:
    """Lines with characters easily taken for ASCII, how many, and the line with those replaced."""
    away = F.length(column) - F.length(F.translate(column, "".join(CONFUSABLE), ""))
    fixed = F.translate(column, "".join(CONFUSABLE), "".join(CONFUSABLE.values()))
    return of.withColumn("n", away).filter("n > 0").withColumn("fixed", fixed)


def comments(of: DataFrame) -> DataFrame:
    """The comment of each line by its first number sign: column, text, whether the line has nothing else, whether it is a pragma."""
    found = of.filter(F.contains("line", F.lit("#")))
    at = F.locate("#", F.col("line"))
    cut = found.withColumn("col", at - 1).withColumn("comment", F.expr("substring(line, locate('#', line))"))
    return cut.withColumn("own_line", F.expr("trim(substring(line, 1, col)) = ''")).withColumn("pragma", is_pragma(F.col("comment")))


def comment_blocks(found: DataFrame, key: str) -> DataFrame:
    """Runs of at least two own-line comments in one column on successive lines, of which one is not empty."""
    own = found.filter("own_line")
    window = Window.partitionBy(key).orderBy("line_no")
    broken = (F.lag("line_no").over(window) != F.col("line_no") - 1) | (F.lag("col").over(window) != F.col("col"))
    marked = islands(own.withColumn("_new", F.coalesce(broken, F.lit(True))), [key], "line_no", F.col("_new"))
    blocks = marked.groupBy(key, "island").agg(
        F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.bool_or(F.trim(F.ltrim(F.regexp_replace("comment", "^#+", ""))) != "").alias("filled"),
    )
    return blocks.filter("last_line > first_line and filled").select(key, "first_line", "last_line")
