"""Token counts with a whole-token shortcut (operator 2).

Byte-level BPE splits a text into pre-tokens and merges each on its own, so a text's count is the
sum over its pre-tokens. ``prove`` asks the tokenizer library offline, once on the driver,

* how it classes each character of the basic plane (letter, number, white space, other), from
  which the pre-token pattern is built, and
* which vocabulary strings are one pre-token that encodes alone as one token.

Executors then cut texts with the proven pattern, count proven pre-tokens as one and let the
library merge only the rest, each distinct string once per task (the memo is emptied at a fixed
size). A text with a character outside the proven classes or with an added token's string, and
any tokenizer that is not plain byte-level BPE, goes to the library whole; the counts are the
library's in every case.

The plan is one narrow stage. The broadcast holds the tokenizer's definition, at most one string per vocabulary entry
and one byte per character of the basic plane, whatever the corpus; executors open no file. Null texts count as
empty: 0 bytes and 0 tokens. Very long texts are counted whole, in the memory of one task. Rows are counted one by
one, so repeated rows and null ids pass through; an empty table gives an empty result; columns other than id and text
are not read, so their names may clash with results.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import groupby
from pathlib import Path

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm.common import map_arrow, table

#: Distinct strings that a task remembers before it forgets them all.
MEMO = 400_000
SCHEMA = "doc_id long, n_bytes long, n_tokens long"


def _ranges(codes: list[int]) -> str:
    """A character class body for sorted code points."""
    parts = []
    for _, run in groupby(enumerate(codes), lambda x: x[1] - x[0]):
        run = [c for _, c in run]
        parts.append(f"\\u{run[0]:04x}-\\u{run[-1]:04x}")
    return "".join(parts)


def prove(path: str) -> dict | None:
    """What the shortcut may rely on, or None if this tokenizer is not plain byte-level BPE."""
    tokenizer = Tokenizer.from_file(path)
    spec = json.loads(tokenizer.to_str())
    pre = spec["pre_tokenizer"] or {}
    plain = (
        spec["model"]["type"] == "BPE" and spec["normalizer"] is None and pre.get("type") == "ByteLevel"
        and pre["use_regex"] and not pre["add_prefix_space"] and not spec["model"].get("dropout")
    )
    if not plain:
        return None

    def pieces(text: str) -> list[tuple[int, int]]:
        return [at for _, at in tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    kinds: dict[str, list[int]] = {"L": [], "N": [], "S": [], "O": []}
    for code in range(0x10000):
        if 0xD800 <= code < 0xE000:
            continue
        char = chr(code)
        kind = [k for k, text in (("L", "a" + char), ("N", "1" + char), ("O", "!" + char)) if len(pieces(text)) == 1]
        kinds[kind[0] if len(kind) == 1 else "S"].append(code)
    # White space joins none of the three and forms one piece with a line feed.
    kinds["S"] = [c for c in kinds["S"] if len(pieces("\n" + chr(c))) == 1]
    added = [t["content"] for t in spec["added_tokens"]]
    known = sorted(c for codes in kinds.values() for c in codes)
    letter, number, space, other = (_ranges(kinds[k]) for k in "LNSO")
    pattern = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[{other}]+|[{space}]+(?![^{space}])|[{space}]+"
    cut = re.compile(pattern)
    strings = [s for s in tokenizer.decode_batch([[i] for i in range(tokenizer.get_vocab_size())], skip_special_tokens=False) if "�" not in s]
    single = [s for s in strings if s not in added and cut.findall(s) == [s] and len(pieces(s)) == 1]
    whole = [s for s, e in zip(single, tokenizer.encode_batch(single, add_special_tokens=False), strict=True) if len(e.ids) == 1]
    refused = "|".join([f"[^{_ranges(known)}]", *map(re.escape, added)])
    return {"pattern": pattern, "refused": refused, "whole": whole}


class Counter:
    """Counts tokens of whole texts; built once per task."""

    def __init__(self, path: str, proof: dict | None, definition: str | None = None):
        """``definition``: the content of the file at ``path``, for executors that do not see it."""
        self.tokenizer = Tokenizer.from_str(definition) if definition else Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.proof = proof
        if proof:
            self.cut, self.refused = re.compile(proof["pattern"]), re.compile(proof["refused"])
            self.memo = self._fresh()

    def _fresh(self) -> dict[str, int]:
        counter = self

        class Memo(dict):
            def __missing__(self, piece: str) -> int:
                n = self[piece] = counter.merged(piece)
                return n

        return Memo(dict.fromkeys(self.proof["whole"], 1))

    def merged(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def count(self, text: str) -> int:
        if not self.proof or self.refused.search(text):
            return self.merged(text)
        if len(self.memo) > MEMO:
            self.memo = self._fresh()
        return sum(map(self.memo.__getitem__, self.cut.findall(text)))


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, n_bytes, n_tokens) per row of ``docs``; ``path`` is read on the driver alone."""
    context = docs.sparkSession.sparkContext
    definition = Path(path).read_text(encoding="utf-8")
    shared = context.broadcast((prove(path), definition))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path, *shared.value)
        for batch in batches:
            counts = pa.array([counter.count(t) if t else 0 for t in batch.column("t").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), counts], ["doc_id", "n_bytes", "n_tokens"])

    columns = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
        F.col(text_col).alias("t"),
    )
    return map_arrow(columns, run, SCHEMA)


def query(spark: SparkSession, sf_dir: str, name: str = "byte_bpe_50k.json", limit: int = 1024) -> DataFrame:
    counted = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(name))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
