"""BPE encoding and decoding by a tokenization automaton (operator 13).

``compile_merges`` turns a merge list into a deterministic automaton over tokens. It starts with one state that reads every base symbol, and
each merge (u, v) -> w is applied as a gadget: the state p that u leads to, if it reads v, is left to the other arcs; u now leads to a copy of p
without the arc v; every state that reads u gets an arc w, which leads where v leads. What remains are the token sequences that the merges
leave alone, one for each string. All arcs of a token lead to one state, so a gadget adds one state at most. States are copies with one arc
less, so only what differs is stored: a state's source and lost arc, a token's left part and target. ``Automaton.reads`` looks an arc up in these
tables and keeps it in a transition table.

``Encoder.word`` runs a pre-split word through the automaton from left to right. Every prefix of a word has one path; its last token is the one token
that ends there and that the state of the prefix before it reads. ``decode`` emits the arcs' labels.

The construction holds where every merge joins parts that earlier merges (or base symbols) made and no two merges make the same token; anything else
is refused with ValueError when compiling, as is a vocabulary without a symbol for every byte. Texts are normalised and cut into words as the file says. For a file of the kind this operator
is tuned to (NFC, white space, lower case; one pattern of letters, single digits and others) the library is asked offline, for every character of the basic
plane, how it treats it; texts of plain characters are then cut by the proven pattern, all others, and all texts under other settings, are normalised
and cut by the library's own normaliser and pre-tokenizer. Words go through the automaton in every case.

The plan is one narrow stage. The broadcast is the file's content and the proof, whatever the corpus; words seen before are remembered, up to a
fixed number per worker. Null texts count as empty: no tokens, an empty decoded text. Very long texts are encoded whole, in the
memory of one task. Special strings inside texts become their tokens, as by the library's default. Rows are encoded one by one, so ties, repeated rows and null ids pass
through; an empty table gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm.common import map_arrow, table

#: Words and transitions that a worker remembers before it forgets them all.
MEMO = 400_000


class Automaton:
    """Tables of the compiled merges. Tokens have the file's ids; state 0 reads every base symbol."""

    def __init__(self, left: list[int], made: list[int], target: list[int], source: list[int], lost: list[int], opened: list[int], dead: set[int]):
        #: By token: its left part (-1 for base symbols), the merge that made it (-1), the state that all its arcs lead to.
        self.left, self.made, self.target = left, made, target
        #: By state: the state it was copied from, the arc taken away, the merge that did so.
        self.source, self.lost, self.opened = source, lost, opened
        self.dead = dead
        self.table: dict[int, bool] = {}
        self._number()

    def _number(self) -> None:
        """Number the tree of copies so that a state's copies are an interval, and list by arc the states that lost it; none of these is a copy of another."""
        n = len(self.source)
        copies = [1] * n
        for state in range(n - 1, 0, -1):
            copies[self.source[state]] += copies[state]
        enter, free = [0] * n, [1] * n
        for state in range(1, n):
            up = self.source[state]
            enter[state] = enter[up] + free[up]
            free[up] += copies[state]
        self.enter, self.leave = enter, [e + c for e, c in zip(enter, copies, strict=True)]
        losers: dict[int, list[tuple[int, int]]] = {}
        for state in range(1, n):
            losers.setdefault(self.lost[state], []).append((enter[state], state))
        self.losers = {token: sorted(states) for token, states in losers.items()}

    def reads(self, state: int, token: int) -> bool:
        """Whether the state has an arc for the token."""
        key = state << 32 | token
        found = self.table.get(key)
        if found is None:
            if len(self.table) > MEMO:
                self.table.clear()
            found = self.table[key] = self._derive(state, token)
        return found

    def _derive(self, state: int, token: int) -> bool:
        # The state lacks the arc if it, or a state it is copied from, lost the token; and since an arc is added where the token's
        # left part is read, also if the left part had been lost by then, and so on to the base symbol.
        if token in self.dead:
            return False
        at, before = self.enter[state], len(self.made)
        while True:
            losers = self.losers.get(token)
            if losers:
                i = bisect_right(losers, (at, state)) - 1
                if i >= 0 and self.leave[losers[i][1]] > at and self.opened[losers[i][1]] <= before:
                    return False
            before = self.made[token]
            if before < 0:
                return True
            token = self.left[token]


def compile_merges(vocabulary: dict[str, int], merges: list[tuple[str, str]]) -> Automaton:
    """The automaton after one gadget per merge, in order."""
    size = max(vocabulary.values(), default=-1) + 1
    results = {u + v for u, v in merges}
    if len(results) != len(merges):
        raise ValueError("two merges make the same token")
    left, made, target = [-1] * size, [-1] * size, [0] * size
    source, lost, opened = [0], [-1], [-1]
    known = {i for s, i in vocabulary.items() if s not in results}
    dead: set[int] = set()

    def reads(state: int, token: int) -> bool:
        # A token made after the state was opened is read where its left part is; an older one where the source reads it, unless it was lost.
        while state or made[token] >= 0:
            if opened[state] > made[token]:
                if lost[state] == token:
                    return False
                state = source[state]
            else:
                token = left[token]
        return True

    for n, (u, v) in enumerate(merges):
        if u + v not in vocabulary or not {vocabulary.get(u), vocabulary.get(v)} <= known:
            raise ValueError(f"merge {n} joins parts that no earlier merge made")
        a, b, w = vocabulary[u], vocabulary[v], vocabulary[u + v]
        before, after = target[a], target[b]
        if a in dead or b in dead or not reads(before, b):
            dead.add(w)
        else:
            source.append(before)
            lost.append(b)
            opened.append(n)
            target[a] = len(source) - 1
        left[w], made[w], target[w] = a, n, after
        known.add(w)
    return Automaton(left, made, target, source, lost, opened, dead)


class Encoder:
    """Words to ids along the automaton's only path; built from the file's content."""

    def __init__(self, model: dict):
        self.vocabulary: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        if model.get("unk_token") or model.get("continuing_subword_prefix") or model.get("dropout") or model.get("ignore_merges") or model.get("byte_fallback"):
            raise ValueError("only plain merges are compiled")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = compile_merges(self.vocabulary, merges)
        # Tokens by their symbols: inner ones by their text, last ones by the text before the suffix.
        suffix = len(self.end)
        self.last = {s[:-suffix]: i for s, i in self.vocabulary.items() if s.endswith(self.end)} if suffix else self.vocabulary
        self.inner = {s: i for s, i in self.vocabulary.items() if not s.endswith(self.end)} if suffix else self.vocabulary
        self.longest = max(map(len, [*self.last, *self.inner]), default=0)
        if not all(symbol in tokens for symbol in byte_symbols() for tokens in (self.last, self.inner)):
            raise ValueError("a byte has no symbol in the vocabulary")

    def word(self, word: str) -> list[int]:
        """Ids of one pre-split word in the vocabulary's symbols."""
        reads, target, n = self.automaton.reads, self.automaton.target, len(word)
        whole = self.last.get(word)
        if whole is not None and reads(0, whole):
            return [whole]
        path: list[tuple[int, int]] = [(-1, 0)]  # by end: the last token and its length
        for end in range(1, n + 1):
            get = (self.last if end == n else self.inner).get
            for start in range(max(0, end - self.longest), end):
                token = get(word[start:end])
                if token is not None and reads(target[path[start][0]] if start else 0, token):
                    path.append((token, end - start))
                    break
            else:
                raise ValueError(f"no path for {word!r}")
        ids, at = [], n
        while at:
            token, length = path[at]
            ids.append(token)
            at -= length
        return ids[::-1]


def byte_symbols() -> list[str]:
    """The printable symbol of each byte in byte-level vocabularies: printable Latin-1 as it is, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


#: Canonical composition depends on what follows these: Hangul vowels and tails.
JAMO = range(0x1160, 0x1200)
LETTER, NUMBER, SPACE, OTHER = "LNSO"


def prove(definition: str) -> dict | None:
    """What the quick cut may rely on: the class of each plain character and what it is lowered to; None for files of another kind."""
    spec = json.loads(definition)
    tokenizer = Tokenizer.from_str(definition)
    steps = (spec["normalizer"] or {}).get("normalizers") or []
    cut = (spec["pre_tokenizer"] or {}).get("pretokenizers") or []
    ours = (
        [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " "
        and [c["type"] for c in cut] == ["Split", "ByteLevel"] and cut[0]["behavior"] == "Removed" and cut[0]["invert"]
        and cut[0]["pattern"] == {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
        and not cut[1]["add_prefix_space"] and not cut[1]["use_regex"] and not any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"])
    )
    if not ours:
        return None
    composed = {unicodedata.normalize("NFD", chr(c))[1:] for c in range(0x10000)}
    joins = set("".join(composed))
    classes: dict[str, list[int]] = {LETTER: [], NUMBER: [], SPACE: [], OTHER: []}
    lowered: dict[int, str] = {}
    for code in range(0x10000):
        char = chr(code)
        if 0xD800 <= code < 0xE000 or code in JAMO or char in joins or unicodedata.combining(char) or not unicodedata.is_normalized("NFC", char):
            continue
        low = tokenizer.normalizer.normalize_str(char)
        # Lowered characters are cut as they stand, so those that become several are left to the library.
        if len(low) != 1:
            continue
        pieces = [len(tokenizer.pre_tokenizer.pre_tokenize_str(text)) for text in ("a" + low, low + low, "!" + low, low)]
        kind = {(1, 1, 2, 1): LETTER, (2, 2, 2, 1): NUMBER, (2, 1, 1, 1): OTHER, (1, 0, 1, 0): SPACE}.get(tuple(pieces))
        if kind is None or (kind == SPACE) != (low == " "):
            continue
        classes[kind].append(ord(low))
        if low != char:
            lowered[code] = low
    return {"classes": {k: sorted(set(v)) for k, v in classes.items()}, "lowered": lowered}


def _body(codes: list[int]) -> str:
    """A character class body for code points."""
    parts, start = [], None
    for code, following in zip(codes, [*codes[1:], None], strict=True):
        start = code if start is None else start
        if following != code + 1:
            parts.append(f"\\u{start:04x}-\\u{code:04x}")
            start = None
    return "".join(parts)


class Splitter:
    """Whole texts to words in the vocabulary's symbols and ids of special strings."""

    def __init__(self, definition: str, proof: dict | None):
        spec = json.loads(definition)
        self.tokenizer = Tokenizer.from_str(definition)
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.plain_added = not any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"])
        if not self.plain_added:
            raise ValueError("added tokens with matching options are not handled")
        self.added = added
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.proof = proof
        self.symbols = dict(enumerate(byte_symbols()))
        if proof:
            letter, number, space, other = (_body(proof["classes"][k]) for k in (LETTER, NUMBER, SPACE, OTHER))
            self.find = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[{other}]+").findall
            self.refused = re.compile(f"[^{letter}{number}{space}{other}]")
            self.lowered = proof["lowered"]

    def pieces(self, text: str) -> Iterator[tuple[int | None, list[str], bool]]:
        """(special id, words, whether words are raw text) in order."""
        for part in self.specials.split(text) if self.specials else [text]:
            if part in self.added:
                yield self.added[part], [], False
                continue
            low = part.translate(self.lowered) if self.proof else part
            if self.proof and not self.refused.search(low):
                yield None, self.find(low), True
                continue
            normal = self.tokenizer.normalizer.normalize_str(part) if self.tokenizer.normalizer else part
            yield None, [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)], False


class Codec:
    """Encodes and decodes whole texts."""

    def __init__(self, definition: str, proof: dict | None):
        spec = json.loads(definition)
        if spec.get("decoder") is not None or spec.get("post_processor") is not None or spec["model"]["type"] != "BPE":
            raise ValueError("only byte-pair files without decoder and post-processor are handled")
        self.split, self.encoder = Splitter(definition, proof), Encoder(spec["model"])
        labels = {i: s for s, i in spec["model"]["vocab"].items()} | {i: s for s, i in self.split.added.items()}
        self.labels = [labels.get(i) for i in range(max(labels, default=-1) + 1)]
        codec = self

        class Words(dict):
            """Ids of words in symbols."""

            def __missing__(self, word: str) -> list[int]:
                ids = self[word] = codec.encoder.word(word)
                return ids

        class Raw(dict):
            """Ids of words as they stand in the text."""

            def __missing__(self, word: str) -> list[int]:
                ids = self[word] = codec.encoder.word("".join(map(codec.split.symbols.__getitem__, word.encode())))
                return ids

        self.words, self.raw = Words(), Raw()

    def encode(self, text: str) -> list[int]:
        if len(self.words) + len(self.raw) > MEMO:
            self.words.clear()
            self.raw.clear()
        ids: list[int] = []
        for special, words, raw in self.split.pieces(text):
            if special is not None:
                ids.append(special)
            for found in map((self.raw if raw else self.words).__getitem__, words):
                ids += found
        return ids

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, one space between; ids without a label are left out."""
        labels = self.labels
        return " ".join([labels[i] for i in ids if 0 <= i < len(labels) and labels[i] is not None])


_CODECS: dict[str, Codec] = {}


def codec(definition: str, proof: dict | None) -> Codec:
    """The file's codec, compiled once per Python worker, which serves many tasks."""
    if definition not in _CODECS:
        _CODECS.clear()
        _CODECS[definition] = Codec(definition, proof)
    return _CODECS[definition]


def _shared(df: DataFrame, path: str):
    definition = Path(path).read_text(encoding="utf-8")
    return df.sparkSession.sparkContext.broadcast((definition, prove(definition)))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids array<int>) per row; ``path`` is read on the driver alone."""
    shared = _shared(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(*shared.value)
        for batch in batches:
            ids = [coder.encode(t) if t else [] for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, ids), pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "n_tokens", "ids"])

    columns = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    return map_arrow(columns, run, "doc_id long, n_tokens long, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) per row of ids; null ids give an empty text."""
    shared = _shared(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(*shared.value)
        for batch in batches:
            texts = [coder.decode(i or []) for i in batch.column("i").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    columns = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("i"))
    return map_arrow(columns, run, "doc_id long, text string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Both ways in one pass: (doc_id, n_tokens, ids_sha256, decoded_sha256); ids are hashed as little-endian 32-bit integers, texts as UTF-8."""
    shared = _shared(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(*shared.value)
        for batch in batches:
            counts, of_ids, of_texts = [], [], []
            for text in batch.column("t"):
                ids = coder.encode(text.as_py() or "")
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                of_texts.append(hashlib.sha256(coder.decode(ids).encode()).hexdigest())
            arrays = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_texts, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    columns = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    return map_arrow(columns, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str, name: str = "word_bpe_49k.json") -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path(name))
