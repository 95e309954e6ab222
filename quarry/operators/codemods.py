"""Import codemods by spans of the source: members of an import go or stay one by one, what else stands in the file is not touched.

``import_edits`` turns the names to remove (or to keep) of each file into edits by character span; ``fixes.apply_edits`` applies them. A removed member takes its comma and
the comment behind it along, comments on lines of their own stay. A statement without members left goes with its line, or with its semicolon if it shares the line; the last statement of a block that
would end empty becomes ``pass``. A file that does not parse is left as it is, and so are star imports.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import fixes
from quarry.operators.rel import spread
from quarry.shipping import ship

EDIT = "path string, start int, end int, content string"


class Source:
    """A text with the places of its lines."""

    def __init__(self, text: str):
        self.text = text
        self.starts = [0, *(m.end() for m in re.finditer("\r\n|\r|\n", text))]

    def at(self, row: int, byte_col: int) -> int:
        """The character at a row and a column in UTF-8 bytes, as the parser tells places."""
        start = self.starts[row - 1]
        end = self.starts[row] if row < len(self.starts) else len(self.text)
        line = self.text[start:end]
        return start + (byte_col if line.isascii() else len(line.encode()[:byte_col].decode(errors="ignore")))

    def span(self, node: ast.AST) -> tuple[int, int]:
        return self.at(node.lineno, node.col_offset), self.at(node.end_lineno, node.end_col_offset)

    def blanks(self, at: int) -> int:
        """Past spaces and tabs."""
        while at < len(self.text) and self.text[at] in " \t\f":
            at += 1
        return at

    def line_start(self, at: int) -> int:
        while at and self.text[at - 1] not in "\r\n":
            at -= 1
        return at

    def line_end(self, at: int) -> int:
        """The place behind the line's end."""
        found = re.compile("\r\n|\r|\n").search(self.text, at)
        return found.end() if found else len(self.text)

    def comment(self, at: int) -> int:
        """Behind a comment that begins here after blanks, else ``at``."""
        start = self.blanks(at)
        if self.text[start : start + 1] != "#":
            return at
        while start < len(self.text) and self.text[start] not in "\r\n":
            start += 1
        return start


def _members(source: Source, node: ast.Import | ast.ImportFrom, gone: list[bool]) -> Iterator[tuple[int, int, str]]:
    """Edits that take some members out of a statement; at least one stays."""
    text = source.text
    spans = [source.span(x) for x in node.names]
    end = source.span(node)[1]
    commas = []
    for i, (_, stop) in enumerate(spans):
        following = spans[i + 1][0] if i + 1 < len(spans) else end
        # Only blanks, line ends, comments and backslashes stand between members beside the comma.
        found = re.compile(r"(?:[ \t\f\r\n\\]|#[^\r\n]*)*,").match(text, stop, following)
        commas.append(found.end() - 1 if found else None)
    bracket = isinstance(node, ast.ImportFrom) and text[:end].rstrip().endswith(")") and text[end - 1] == ")"
    last_kept = max(i for i, out in enumerate(gone) if not out)
    if not bracket:
        i = 0
        while i < len(gone):
            if gone[i] and i < last_kept:
                yield spans[i][0], spans[i + 1][0], ""
            i += 1
        if last_kept < len(gone) - 1:
            yield spans[last_kept][1], spans[-1][1], ""
        return
    # The comma behind the last member that stays goes if the last member had none.
    if last_kept < len(gone) - 1 and commas[-1] is None:
        yield commas[last_kept], commas[last_kept] + 1, ""
    for i, out in enumerate(gone):
        if not out:
            continue
        start, stop = spans[i]
        stop = commas[i] + 1 if commas[i] is not None else stop
        alone = not text[source.line_start(start) : start].strip()
        behind = source.comment(stop)
        rest = source.blanks(behind)
        at_end = rest == len(text) or text[rest] in "\r\n"
        if alone and at_end:
            yield source.line_start(start), source.line_end(rest), ""
        elif at_end:
            # What stands before it on the line stays.
            before = start
            while text[before - 1] in " \t\f":
                before -= 1
            yield before, behind, ""
        elif text[rest] == ")":
            before = start
            while text[before - 1] in " \t\f" and text[source.line_start(start) : start].strip():
                before -= 1
            yield before, stop, ""
        else:
            yield start, source.blanks(stop), ""


def _statement(source: Source, node: ast.stmt, as_pass: bool) -> Iterator[tuple[int, int, str]]:
    """The edit that takes a whole statement out. Comments on own lines inside its brackets are kept before it."""
    text = source.text
    start, stop = source.span(node)
    notes = re.findall(r"(?m)^[ \t\f]*(#[^\r\n]*)", text[start:stop])
    begin = source.line_start(start)
    indent = text[begin:start]
    if as_pass:
        kept = "".join(f"{note}\n{indent}" for note in notes) if not indent.strip() else ""
        yield start, stop, kept + "pass"
        return
    behind = source.blanks(stop)
    semicolon = text[behind : behind + 1] == ";"
    follows = source.blanks(behind + 1) if semicolon else behind
    more = semicolon and follows < len(text) and text[follows] not in "\r\n#"
    if more:
        yield start, follows, ""
    elif not indent.strip():
        yield begin, source.line_end(source.comment(follows)), "".join(f"{indent}{note}\n" for note in notes)
    else:
        # The last of several on a line: the semicolon before it goes.
        before = start
        while text[before - 1] in " \t\f;":
            before -= 1
        yield before, behind + semicolon, ""


def edits_of(text: str, names: set[str], keep: bool = False) -> list[tuple[int, int, str]]:
    """Edits (start, end, content) that remove the imports that bind ``names``, or with ``keep`` all others."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    source, found = Source(text), []
    for block in (b for x in ast.walk(tree) for f in ("body", "orelse", "finalbody") if isinstance(b := getattr(x, f, None), list) and b and isinstance(b[0], ast.stmt)):
        whole = []
        for node in block:
            if not isinstance(node, (ast.Import, ast.ImportFrom)) or isinstance(node, ast.ImportFrom) and (node.module == "__future__" or node.names[0].name == "*"):
                continue
            bound = [x.asname or (x.name.split(".")[0] if isinstance(node, ast.Import) else x.name) for x in node.names]
            gone = [(b in names) != keep for b in bound]
            if all(gone):
                whole.append(node)
            elif any(gone):
                found += _members(source, node, gone)
        emptied = len(whole) == len(block) and block is not tree.body
        for node in whole:
            found += _statement(source, node, emptied and node is block[-1])
    return _merged(source, sorted(found))


def _merged(source: Source, edits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Edits that meet or overlap as one; a line of which nothing is left goes whole."""
    out: list[tuple[int, int, str]] = []
    for start, end, content in edits:
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]), out[-1][2] + content)
        else:
            out.append((start, end, content))
    for i, (start, end, content) in enumerate(out):
        begin, rest = source.line_start(start), source.blanks(end)
        bare = not content and start < end and source.text[end - 1] not in "\r\n" and not source.text[begin:start].strip()
        if bare and (rest == len(source.text) or source.text[rest] in "\r\n"):
            out[i] = (begin, source.line_end(rest), "")
    return out


def import_edits(files: DataFrame, names: DataFrame, keep: bool = False) -> DataFrame:
    """(path, start, end, content) for files (path, text) and names (path, name); a file without names is left as it is. The names of a file's imports are one list."""
    ship(files.sparkSession)
    listed = names.where("name is not null").groupBy("path").agg(F.collect_set("name").alias("names"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("path", "text", "names")), strict=True):
                rows += [(path, *e) for e in edits_of(text or "", set(wanted), keep)]
            columns = zip(*rows, strict=True) if rows else [()] * 4
            types = [pa.string(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["path", "start", "end", "content"])

    return spread(files.join(listed, "path").select("path", "text", "names")).mapInArrow(run, EDIT)


def without_imports(files: DataFrame, names: DataFrame, keep: bool = False) -> DataFrame:
    """``files`` (path, text) without the imports that bind ``names`` (path, name); ``keep``: without all others."""
    return fixes.apply_edits(files.select("path", "text"), import_edits(files, names, keep), "path")
