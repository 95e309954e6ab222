"""Benchmark decontamination with an FM-index per training shard (operator 9).

``build_index`` makes a table of shards from whole documents, once for any number of benchmarks. A shard numbers its own
plain words; its text is the runs of its documents, each closed by a separator. Separators are distinct symbols ordered by
place, so no suffix comparison crosses one.

* Suffixes are sorted by three symbols at once and then by prefix doubling in numpy, in which only ties are sorted again.
* A wavelet matrix over the Burrows-Wheeler transform, stored as bits, answers ranks; all phrases walk backwards
  at once, as arrays of ranges.
* Suffix positions are kept for run starts and every ``SAMPLED``-th place; other rows walk to one.
* Occurrences become spans of document words, merged where they touch: the spans to remove.

``search_index`` takes a benchmark against a stored index: no text is read again, and no document is shuffled (only documents
of more than ``INDEX`` words, which are cut into overlapping runs, have their spans brought together by a shuffle of spans).
``search`` judges rows in one narrow pass without storing anything, for a stage that sees each document once: there the batches
are the shards, and a word that no phrase of the benchmark uses ends a run, for it matches nothing. Both are exact.

Phrases are the windows of 10 consecutive words of an item (an item of fewer words is one). They
are broadcast in blocks of at most ``BLOCK`` phrases, in the order of their text. Each further block is a pass of its own over the
written result of the one before, so that a task holds one block and the driver releases each after its pass. A block is
fetched to the driver by its number, at most ``BLOCK`` phrases with the items that hold them.

Defined results: null or empty texts have no words and no hits; items without id or words are left
out; an item given twice counts once; the documents' rows are judged one by one, so repeated rows and
null ids pass; texts of any length are read whole, a text in the memory of one task. An empty benchmark hits nothing, an
empty table gives an empty result. Extra columns are not read (but kept as ``row``), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import PLAIN_WORD, lower_ascii, map_arrow, plain_words, save, table, text_bytes

WINDOW = 10
#: Phrases in a broadcast block: some 100 bytes each.
BLOCK = 200_000
#: Items of a phrase in one row of a block; a phrase that more items share fills more rows.
ITEMS = 64
#: Every so many places of a run the suffix position is stored.
SAMPLED = 16
#: Words of a shard, and of a run of one document; longer documents are cut into runs that overlap by a phrase less a word.
INDEX = 1 << 20


class Wavelet:
    """Wavelet matrix: ranks of symbols in a sequence, and the symbols themselves."""

    def __init__(self, levels: list[np.ndarray]):
        """``levels``: per bit, from the highest, whether the symbols at that level have it."""
        self.levels = []
        for bit, ones in zip(range(len(levels) - 1, -1, -1), levels, strict=True):
            before = np.zeros(len(ones) + 1, np.int32)
            np.cumsum(ones, out=before[1:])
            self.levels.append((bit, before, len(ones) - int(before[-1])))

    @staticmethod
    def bits(symbols: np.ndarray, bits: int) -> list[np.ndarray]:
        levels = []
        for bit in range(bits - 1, -1, -1):
            ones = ((symbols >> bit) & 1).astype(bool)
            levels.append(ones)
            symbols = np.concatenate([symbols[~ones], symbols[ones]])
        return levels

    def rank(self, symbols: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
        """For each array of places, how often each symbol stands before its place."""
        start, at = np.zeros(len(symbols), np.int64), list(places)
        for bit, before, zeros in self.levels:
            one = (symbols >> bit) & 1 == 1
            start, *at = (np.where(one, zeros + before[x], x - before[x]) for x in (start, *at))
        return [x - start for x in at]

    def at(self, places: np.ndarray) -> np.ndarray:
        """The symbols at places."""
        found = np.zeros(len(places), np.int64)
        for _, before, zeros in self.levels:
            one = before[places + 1] > before[places]
            found = found * 2 + one
            places = np.where(one, zeros + before[places], places - before[places])
        return found


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffixes in order; 0 is a separator, distinct by place and less than any word."""
    n = len(text)
    separators = text == 0
    rank = np.where(separators, np.cumsum(separators) - 1, text.astype(np.int64) + int(separators.sum()) - 1)
    # As many symbols at once as a 64-bit key holds, three at most; what follows the end never decides, for a separator stands there.
    width = max(1, int(rank.max()).bit_length()) if n else 1
    reach = max(1, min(3, 63 // width))
    key = rank.copy()
    for ahead in range(1, reach):
        key <<= width
        key[: n - ahead] |= rank[ahead:]
    order = np.argsort(key)
    rank, open_ = _ranked(order, key[order], n)
    while len(open_):
        # Only places whose rank is shared are sorted again, by (rank, rank of what follows).
        after = np.minimum(open_ + reach, n - 1)
        key = rank[open_] * n + rank[after]
        by = np.argsort(key)
        place, key = open_[by], key[by]
        base = rank[place]
        new = np.empty(len(place), np.int64)
        first = np.r_[True, base[1:] != base[:-1]]
        starts = np.maximum.accumulate(np.where(first, np.arange(len(place)), 0))
        fresh = np.r_[True, key[1:] != key[:-1]]
        heads = np.maximum.accumulate(np.where(fresh, np.arange(len(place)), 0))
        new = base + heads - starts
        rank[place] = new
        shared = np.r_[~fresh[1:], False] | ~fresh
        open_ = place[shared]
        reach *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order


def _ranked(order: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The rank of each place (of equal keys the first row), and the places whose rank is shared."""
    fresh = np.r_[True, keys[1:] != keys[:-1]]
    heads = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = heads
    return rank, order[np.r_[~fresh[1:], False] | ~fresh]


class FMIndex:
    """Index of runs of word numbers (1 and up), each closed by a 0."""

    def __init__(self, text: np.ndarray, n_symbols: int):
        self._load(**self.parts(text, n_symbols))

    @staticmethod
    def parts(text: np.ndarray, n_symbols: int) -> dict:
        """What makes an index: bits of the wavelet matrix by level, symbol counts, which rows keep their position, and these positions."""
        n = len(text)
        order = suffix_order(text)
        starts = np.r_[True, text[:-1] == 0]
        ordinal = np.arange(n) - np.maximum.accumulate(np.where(starts, np.arange(n), 0))
        kept = (ordinal % SAMPLED == 0)[order]
        levels = Wavelet.bits(text[order - 1].astype(np.int32), max(1, int(n_symbols - 1).bit_length()))
        return {"levels": levels, "counts": np.bincount(text, minlength=n_symbols), "kept": kept, "positions": order[kept]}

    def _load(self, levels: list[np.ndarray], counts: np.ndarray, kept: np.ndarray, positions: np.ndarray) -> None:
        self.size = len(kept)
        self.wavelet = Wavelet(levels)
        self.first = np.r_[0, np.cumsum(counts)]
        self.kept, self.kept_before, self.positions = kept, np.r_[0, np.cumsum(kept)], positions

    @staticmethod
    def packed(text: np.ndarray, n_symbols: int) -> dict[str, bytes]:
        """The parts as bytes, a bit per symbol and level."""
        parts = FMIndex.parts(text, n_symbols)
        return {
            "levels": b"".join(np.packbits(x).tobytes() for x in parts["levels"]), "counts": parts["counts"].astype(np.int32).tobytes(),
            "kept": np.packbits(parts["kept"]).tobytes(), "positions": parts["positions"].astype(np.int32).tobytes(),
        }

    @classmethod
    def unpacked(cls, size: int, levels: bytes, counts: bytes, kept: bytes, positions: bytes) -> FMIndex:
        index = cls.__new__(cls)
        rows = np.frombuffer(levels, np.uint8).reshape(-1, -(-size // 8))
        bits = lambda row: np.unpackbits(row, count=size).astype(bool)
        index._load([bits(r) for r in rows], np.frombuffer(counts, np.int32), bits(np.frombuffer(kept, np.uint8)), np.frombuffer(positions, np.int32))
        return index

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of phrases, given as right-aligned rows of word numbers."""
        width = phrases.shape[1]
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        alive = np.arange(len(phrases))
        for step in range(width):
            active = alive[lengths[alive] > step]
            if not len(active):
                break
            word = phrases[active, width - 1 - step]
            a, b = self.wavelet.rank(word, low[active], high[active])
            low[active], high[active] = self.first[word] + a, self.first[word] + b
            alive = alive[high[alive] > low[alive]]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows."""
        found = np.empty(len(rows), np.int64)
        which, steps = np.arange(len(rows)), 0
        while len(rows):
            there = self.kept[rows]
            found[which[there]] = self.positions[self.kept_before[rows[there]]] + steps
            rows, which = rows[~there], which[~there]
            if len(rows):
                word = self.wavelet.at(rows)
                rows = self.first[word] + self.wavelet.rank(word, rows)[0]
                steps += 1
        return found


class Phrases:
    """A block of phrases with their own numbering of words."""

    def __init__(self, windows: list[str], items: list[list[int]]):
        merged: dict[str, set[int]] = {}
        for window, ids in zip(windows, items, strict=True):
            merged.setdefault(window, set()).update(ids)
        words = [w.encode().split() for w in merged]
        self.number = {w: i for i, w in enumerate(sorted({x for ws in words for x in ws}), 1)}
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.rows = np.zeros((len(words), int(self.lengths.max())), np.int32)
        for row, ws in zip(self.rows, words, strict=True):
            row[len(row) - len(ws) :] = [self.number[w] for w in ws]
        self.offsets = np.r_[0, np.cumsum([len(x) for x in merged.values()])]
        self.items = np.array([i for x in merged.values() for i in sorted(x)], np.int64)

    def find(self, texts: list[bytes]) -> tuple[list[int], list[list[tuple[int, int]]], list[list[int]]]:
        """Per text: words, merged spans [start, end) and the items that occur."""
        shortest, width = int(self.lengths.min()), self.rows.shape[1]
        counts, runs, size = [], [], 0
        hits: list[tuple[np.ndarray, ...]] = []
        for doc, text in enumerate(texts):
            words = plain_words(text)
            counts.append(len(words))
            if len(words) < shortest:
                continue
            ids = np.fromiter(map(self.number.get, words, repeat(0)), np.int32, len(words))
            edges = np.flatnonzero(np.diff(np.r_[False, ids > 0, False]))
            starts, ends = edges[::2], edges[1::2]
            long = ends - starts >= shortest
            for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
                # A very long run is cut into parts that overlap by a phrase less a word.
                for cut in range(a, max(a + 1, b - width + 1), INDEX):
                    part = ids[cut : min(b, cut + INDEX + width - 1)]
                    runs.append((doc, cut, part))
                    size += len(part) + 1
                    if size > INDEX:
                        hits.append(self._hits(runs))
                        runs, size = [], 0
        if runs:
            hits.append(self._hits(runs))
        return counts, *self.gathered(hits, len(texts))

    def gathered(self, hits: list[tuple[np.ndarray, ...]], n: int) -> tuple[list[list[tuple[int, int]]], list[list[int]]]:
        """Merged spans and items of each of ``n`` documents, from (document, place, phrase) of occurrences."""
        spans: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        items: list[list[int]] = [[] for _ in range(n)]
        if hits:
            doc, start, phrase = (np.concatenate(x) for x in zip(*hits, strict=True))
            order = np.lexsort((start, doc))
            ends = start + self.lengths[phrase]
            for d, a, b in zip(doc[order].tolist(), start[order].tolist(), ends[order].tolist(), strict=True):
                if spans[d] and a <= spans[d][-1][1]:
                    spans[d][-1] = (spans[d][-1][0], max(b, spans[d][-1][1]))
                else:
                    spans[d].append((a, b))
            pairs = np.unique(np.stack([doc, phrase]), axis=1)
            for d, p in pairs.T.tolist():
                items[d].extend(self.items[self.offsets[p] : self.offsets[p + 1]].tolist())
            items = [sorted(set(x)) for x in items]
        return spans, items

    def _hits(self, runs: list[tuple[int, int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, word place and phrase of every occurrence in the runs."""
        gap = np.zeros(1, np.int32)
        text = np.concatenate([x for _, _, part in runs for x in (part, gap)])
        starts = np.cumsum([0, *(len(part) + 1 for _, _, part in runs[:-1])])
        run, place, phrase = self.occurrences(FMIndex(text, len(self.number) + 1), starts, self.rows, np.arange(len(self.rows)))
        docs, firsts = np.array([r[0] for r in runs], np.int64), np.array([r[1] for r in runs], np.int64)
        return docs[run], firsts[run] + place, phrase

    def occurrences(self, index: FMIndex, starts: np.ndarray, rows: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Run, place in the run and phrase of every occurrence of the phrases ``which``, given as ``rows`` of the index's numbers."""
        low, high = index.search(rows, self.lengths[which])
        found = np.flatnonzero(high > low)
        many = high[found] - low[found]
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low[found], many)
        places = index.locate(at)
        run = np.searchsorted(starts, places, side="right") - 1
        return run, places - starts[run], which[np.repeat(found, many)]

    def within(self, index: FMIndex, words: list[bytes], starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same in a stored shard: only phrases all of whose words the shard has are walked."""
        known = {w: i for i, w in enumerate(words, 1)}
        mine = np.zeros(len(self.number) + 1, np.int32)
        mine[list(self.number.values())] = [known.get(w, 0) for w in self.number]
        mapped = mine[self.rows]
        which = np.flatnonzero(((mapped > 0) | (self.rows == 0)).all(axis=1))
        return self.occurrences(index, starts, mapped[which], which)


def windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``window, item_id``: the distinct phrases of each item, words joined by a space."""
    words = benchmark.select(
        F.col(id_col).cast("long").alias("item_id"),
        F.regexp_extract_all(lower_ascii(F.coalesce(F.col(text_col), F.lit(""))), F.lit(PLAIN_WORD), F.lit(0)).alias("w"),
    ).filter("item_id is not null and size(w) > 0")
    cut = F.expr(f"transform(sequence(1, greatest(1, size(w) - {WINDOW - 1})), i -> array_join(slice(w, i, {WINDOW}), ' '))")
    return words.select("item_id", F.explode(cut).alias("window")).distinct()


def blocks(benchmark: DataFrame, **columns: str) -> Iterator[Phrases]:
    """The benchmark's phrases, at most ``BLOCK`` rows at a time, each with at most ``ITEMS`` items."""
    phrases = windows(benchmark, **columns)
    part = F.pmod(F.xxhash64("item_id"), F.lit(1 << 20)).alias("part")
    # Items of one phrase are dealt out over parts, so that a common phrase makes no endless list.
    total = phrases.count()
    if not total:
        return
    parts = F.lit(1 + total // 1_000_000)
    grouped = phrases.groupBy("window", F.pmod(part, parts).alias("part")).agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    rows = save(grouped.select("window", F.posexplode(F.expr(f"transform(sequence(0, (size(items) - 1) div {ITEMS}), i -> slice(items, i * {ITEMS} + 1, {ITEMS}))")).alias("k", "items")), "phrases")
    n = rows.count()
    n_blocks = -(-n // BLOCK)
    if n_blocks > 1:
        # Hash classes twice as many as blocks, each well below a block's bound.
        classes = 2 * n_blocks
        rows = rows.withColumn("block", F.pmod(F.xxhash64("window", "k"), F.lit(classes)))
        wanted = [rows.filter(F.col("block") == b) for b in range(classes)]
    else:
        wanted = [rows]
    for block in wanted:
        got = block.select("window", "items").toArrow().to_pydict()
        if got["window"]:
            yield Phrases(got["window"], got["items"])


SPANS, ITEMS_TYPE = "array<struct<start:bigint,end:bigint>>", "array<bigint>"
#: A shard: its words in the order of their numbers, the packed index, and its runs: row number, id, words, whether the row is cut
#: into several runs, the run's first word in the document and its place in the index.
_COLUMNS = {
    "size": ("long", pa.int64()), **dict.fromkeys(("words", "levels", "counts", "kept", "positions"), ("binary", pa.binary())),
    **dict.fromkeys(("rows", "ids", "n_words", "firsts", "starts"), ("array<bigint>", pa.list_(pa.int64()))), "cut": ("array<boolean>", pa.list_(pa.bool_())),
}
SHARD = ", ".join(f"{name} {kind}" for name, (kind, _) in _COLUMNS.items())
SHARD_ARROW = pa.schema([(name, kind) for name, (_, kind) in _COLUMNS.items()])


class Numbers(dict):
    """Words numbered from 1 as they come."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self) + 1
        return number


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored FM-index of ``docs``: a row per shard of about ``INDEX`` words, every word of every text in it.

    A run overlaps the next of its document by ``WINDOW - 1`` words, so phrases of up to ``WINDOW`` words are found whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        numbers, parts, runs, size = Numbers(), [], [], 0

        def shard() -> pa.RecordBatch:
            text = np.concatenate(parts)
            packed = FMIndex.packed(text, len(numbers) + 1)
            columns = {"size": [len(text)], "words": [b" ".join(numbers)], **{k: [v] for k, v in packed.items()}}
            columns |= {k: [list(v)] for k, v in zip(("rows", "ids", "n_words", "cut", "firsts", "starts"), zip(*runs, strict=True), strict=True)}
            return pa.RecordBatch.from_pydict(columns, schema=SHARD_ARROW)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), text_bytes(batch.column("t")), strict=True):
                words = plain_words(text)
                row += 1
                for first in range(0, max(1, len(words) - WINDOW + 1), INDEX):
                    part = words[first : first + INDEX + WINDOW - 1]
                    runs.append((row, doc_id, len(words), len(words) > INDEX + WINDOW - 1, first, size))
                    parts.append(np.fromiter(chain(map(numbers.__getitem__, part), (0,)), np.int32, len(part) + 1))
                    size += len(part) + 1
                    if size > INDEX:
                        yield shard()
                        numbers, parts, runs, size = Numbers(), [], [], 0
        if runs:
            yield shard()

    columns = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    return save(map_arrow(columns, run, SHARD), "index")


FOUND = f"row long, doc_id long, n_words long, cut boolean, spans {SPANS}, items {ITEMS_TYPE}"


def search_index(index: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, n_words, spans, items`` per row of the documents of an index, see ``search``."""
    context = index.sparkSession.sparkContext
    found = None
    for phrases in blocks(benchmark):
        # Every pass but the first brings only the rows that it hits.
        shared = context.broadcast(phrases)
        part = save(map_arrow(index, _index_searcher(shared, found is None), FOUND), "hits")
        found = part if found is None else found.unionByName(part.withColumn("cut", F.lit(True))).withColumn("cut", F.lit(True))
        shared.destroy()
    if found is None:
        found = map_arrow(index, _index_searcher(None, True), FOUND)
    whole = found.filter("not cut").select("doc_id", "n_words", "spans", "items")
    together = found.filter("cut").groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"),
    )
    return whole.unionByName(_merged(together).select("doc_id", "n_words", "spans", "items"))


def _span_arrays(spans: list, items: list) -> dict[str, pa.Array]:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return {"spans": pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], span), "items": pa.array(items, pa.list_(pa.int64()))}


def _index_searcher(shared, every: bool):
    """Search of shards; ``every``: rows without a hit as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                shard = batch.slice(at, 1).to_pylist()[0]
                row, cut = np.array(shard["rows"], np.int64), np.array(shard["cut"], bool)
                # Runs of one row lie together.
                heads = np.r_[True, row[1:] != row[:-1]]
                doc = np.cumsum(heads) - 1
                spans, items = [[] for _ in range(doc[-1] + 1)], [[] for _ in range(doc[-1] + 1)]
                if shared is not None:
                    index = FMIndex.unpacked(*(shard[k] for k in ("size", "levels", "counts", "kept", "positions")))
                    run_, place, phrase = shared.value.within(index, shard["words"].split(), np.array(shard["starts"], np.int64))
                    spans, items = shared.value.gathered([(doc[run_], place + np.array(shard["firsts"], np.int64)[run_], phrase)], len(spans))
                told = np.flatnonzero(heads)
                if not every:
                    told = told[[bool(spans[d]) for d in doc[told]]]
                taken = doc[told].tolist()
                columns = {
                    "row": pa.array(row[told]), "doc_id": pa.array([shard["ids"][k] for k in told], pa.int64()), "n_words": pa.array([shard["n_words"][k] for k in told], pa.int64()),
                    "cut": pa.array(cut[told]), **_span_arrays([spans[d] for d in taken], [items[d] for d in taken]),
                }
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def _merged(found: DataFrame) -> DataFrame:
    """``found`` with its spans in order and merged where they touch, its items distinct and sorted."""
    merged = F.expr(
        f"aggregate(array_sort(spans), cast(array() as {SPANS}), (a, x) -> "
        "if(size(a) > 0 and x.start <= element_at(a, -1).end, "
        "concat(slice(a, 1, size(a) - 1), array(struct(element_at(a, -1).start as start, greatest(element_at(a, -1).end, x.end) as end))), "
        "concat(a, array(x))))"
    )
    return found.withColumn("spans", merged).withColumn("items", F.array_sort(F.array_distinct("items")))


def search(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, spans, items``; with ``carry`` the input row as ``row``.

    ``spans`` are the word ranges [start, end) to remove, merged and in order; ``items`` the sorted
    ids of the items that occur. One narrow pass for each block of phrases, without a stored index.
    """
    context = docs.sparkSession.sparkContext
    row = [F.struct("*").alias("row")] if carry else []
    found = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), *row, F.col(text_col).alias("t"), F.lit(0).cast("long").alias("n_words"),
        F.expr(f"cast(array() as {SPANS})").alias("spans"), F.expr(f"cast(array() as {ITEMS_TYPE})").alias("items"),
    )
    last = None
    for phrases in blocks(benchmark):
        if last is not None:
            # Another block: a task never holds two.
            found = save(found, "searched")
            last.destroy()
        last = context.broadcast(phrases)
        found = map_arrow(found, _searcher(last), found.schema)
    if last is None:
        n_words = F.size(F.regexp_extract_all(lower_ascii(F.coalesce("t", F.lit(""))), F.lit(PLAIN_WORD), F.lit(0)))
        found = found.withColumn("n_words", n_words.cast("long"))
    return _merged(found).select(*[c for c in found.columns if c in ("doc_id", "row", "n_words")], "spans", "items")


def _searcher(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shared.value
        for batch in batches:
            counts, spans, items = phrases.find(text_bytes(batch.column("t")))
            old = [[(x["start"], x["end"]) for x in r] for r in batch.column("spans").to_pylist()]
            spans = [a + b for a, b in zip(old, spans, strict=True)]
            items = [a + b for a, b in zip(batch.column("items").to_pylist(), items, strict=True)]
            new = {"n_words": pa.array(counts, pa.int64()), **_span_arrays(spans, items)}
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays([new.get(name, batch.column(name)) for name in names], names)

    return run


def keep(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no phrase occurs, with their columns as they were."""
    return search(docs, benchmark, carry=True).filter("size(spans) = 0").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search_index(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


ORACLE_SQL = r"""
WITH b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i+9], ' ') AS g
  FROM b, unnest(range(1, greatest(2, len(w) - 8))) AS u(i) WHERE len(w) > 0),
d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (
  SELECT r, n, i, array_to_string(w[i:i+n-1], ' ') AS g
  FROM d, sizes, unnest(range(1, greatest(1, len(w) - n + 2))) AS u(i) WHERE len(w) >= n),
occ AS (SELECT r, dw.n, i, item_id FROM dw JOIN win ON dw.n = win.n AND dw.g = win.g),
hit AS (SELECT r, count(DISTINCT i + k)::BIGINT AS n_hit FROM occ, unnest(range(0, n)) AS u(k) GROUP BY r),
its AS (SELECT r, count(*)::BIGINT AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT r, item_id FROM occ) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""
