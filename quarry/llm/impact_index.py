"""Ranked lexical search over a bit-sliced impact index (operator 11).

``build`` cuts the documents into shards of at most ``SHARD_DOCS`` documents and ``SHARD_WORDS`` words. A shard numbers its documents by
ascending id, and keeps for each term the places that hold it and, in bitmaps, one slice per bit, the term's impact in each of them:
``1000000000*tf div (1000*tf + 20*m)``, 20 bits, with m from the document's length against the mean. Two narrow passes over the texts make it: one counts
documents and terms, one writes the shards. Every document and every term is indexed.

``search`` keeps the shards' rows of the queries' terms, spreads the slices to bitmaps over the shard's places, multiplies them by the term's weight and adds
them up per query, both by bitwise carry arithmetic on whole bitmaps, so that all documents of a shard are scored at once. The shard's best are found from
the most significant slice down: as long as more than k documents have the bit they stay alone, else they are sure and the rest goes on. A ranking over the best
of all shards ends it. Scores are exact integers.

Distribution: a group is one shard and one block of at most ``BLOCK`` queries, so neither grows with the corpus; a frequent term has one row per
shard, and the join on terms broadcasts the queries' terms if they are small by their written size, else deals a frequent term's rows to several tasks (AQE). Documents never pass through the driver, nor do counts by term. What the driver holds: the number of documents and of terms.

A document's null, empty or wordless text holds no term: it is not counted and never found. A document of more than ``SHARD_WORDS`` words is a shard of its own, in the memory of one task. Repeated
documents are ranked each by itself; equal scores go by ascending id, null ids last. Queries with one id are one query with the terms of all its rows; a null id is an id;
a query without terms has no rows. Empty tables give an empty result. Columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import PLAIN_WORD, lower_ascii, map_arrow, plain_words, save, table, text_bytes
from quarry.shipping import ship

SHARD_DOCS = 16_384
SHARD_WORDS = 4_000_000
BLOCK = 512
SLICES = 20
INDEX = "shard long, term string, holders int, places binary, slices binary, ids array<long>"


def counts(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """Number of documents with a term, and of their terms with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = terms = 0
        for batch in batches:
            for text in text_bytes(batch.column("t")):
                found = len(plain_words(text))
                n, terms = n + (found > 0), terms + found
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([terms], pa.int64())], ["n", "terms"])

    row = map_arrow(docs.select(F.col(text_col).alias("t")), run, "n long, terms long").agg(F.sum("n").alias("n"), F.sum("terms").alias("terms")).first()
    return row.n or 0, row.terms or 0


class _Terms(dict):
    """Numbers terms as they come."""

    def __missing__(self, term: bytes) -> int:
        number = self[term] = len(self)
        return number


class Shard:
    """The documents of one shard while it fills."""

    def __init__(self):
        self.terms, self.numbers, self.lengths, self.ids = _Terms(), [], [], []
        self.words = 0

    def add(self, doc_id: int | None, words: list[bytes]) -> None:
        self.numbers.append(np.fromiter(map(self.terms.__getitem__, words), np.int32, len(words)))
        self.lengths.append(len(words))
        self.ids.append(doc_id)
        self.words += len(words)

    def rows(self, number: int, n: int, total: int) -> pa.RecordBatch:
        """One row per term, and a first row with the ids by place."""
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        lengths = np.array(self.lengths, np.int64)[order]
        place = np.repeat(np.arange(len(order)), lengths)
        term = np.concatenate([self.numbers[i] for i in order]).astype(np.int64)
        keys, tf = np.unique(term * SHARD_DOCS + place, return_counts=True)
        term, place = keys // SHARD_DOCS, keys % SHARD_DOCS
        m = 50 + (50 * lengths * n) // total
        impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m[place])
        holders = np.bincount(term, minlength=len(self.terms))
        octets = (holders + 7) // 8
        starts = np.concatenate([[0], np.cumsum(octets)])
        # Postings stand in octets of their term, an octet's slices together, so that a term's slices are consecutive bytes.
        at = np.arange(len(term)) - np.repeat(np.cumsum(holders) - holders, holders) + 8 * starts[term]
        padded = np.zeros(8 * starts[-1], np.int64)
        padded[at] = impact
        bits = np.stack([np.packbits((padded >> b & 1).astype(np.uint8)) for b in range(SLICES)], axis=1)
        bounds = np.concatenate([[0], np.cumsum(holders)])

        def binary(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
            return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])

        count = len(self.terms)
        head = pa.RecordBatch.from_arrays(
            [pa.array([number]), pa.array([""]), pa.array([len(order)], pa.int32()), pa.array([None], pa.binary()), pa.array([None], pa.binary()),
             pa.array([[self.ids[i] for i in order]], pa.list_(pa.int64()))],
            ["shard", "term", "holders", "places", "slices", "ids"],
        )
        body = pa.RecordBatch.from_arrays(
            [pa.array(np.full(count, number)), pa.array(list(self.terms), pa.binary()).cast(pa.string()), pa.array(holders.astype(np.int32)),
             binary(place.astype("<u2"), 2 * bounds), binary(bits, SLICES * starts), pa.nulls(count, pa.list_(pa.int64()))],
            ["shard", "term", "holders", "places", "slices", "ids"],
        )
        return pa.Table.from_batches([head, body]).combine_chunks().to_batches()[0]


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index as a written table. A shard's row of the empty term, which no text has, holds its document ids by place."""
    n, total = counts(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shards, shard = TaskContext.get().partitionId(), 0, Shard()
        for batch in batches:
            for doc_id, text in zip(batch.column("i").to_pylist(), text_bytes(batch.column("t")), strict=True):
                words = plain_words(text)
                if not words:
                    continue
                if shard.ids and (len(shard.ids) == SHARD_DOCS or shard.words + len(words) > SHARD_WORDS):
                    yield shard.rows(part << 32 | shards, n, total)
                    shards, shard = shards + 1, Shard()
                shard.add(doc_id, words)
        if shard.ids:
            yield shard.rows(part << 32 | shards, n, total)

    columns = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    return save(map_arrow(columns, run, INDEX), "impact-index")


def add(a: list[int], b: list[int]) -> list[int]:
    """The sum of two bit-sliced numbers per place: a ripple of carries over whole bitmaps, lowest slice first."""
    if len(a) < len(b):
        a, b = b, a
    out, carry = [], 0
    for i, x in enumerate(a):
        if i < len(b):
            y = b[i]
            half = x ^ y
            out.append(half ^ carry)
            carry = x & y | half & carry
        elif carry:
            out.append(x ^ carry)
            carry &= x
        else:
            out.append(x)
    if carry:
        out.append(carry)
    return out


def times(slices: list[int], weight: int) -> list[int]:
    """Bit-sliced numbers times a constant: a shifted copy is added for every bit of the constant."""
    out: list[int] = []
    for bit in range(weight.bit_length()):
        if weight >> bit & 1:
            out = add(out, [0] * bit + slices)
    return out


def spread(places: bytes, slices: bytes) -> list[int]:
    """A term's packed slices as bitmaps over the shard's places: place p is bit p."""
    at = np.frombuffer(places, "<u2")
    packed = np.unpackbits(np.frombuffer(slices, np.uint8).reshape(-1, SLICES).T, axis=1)[:, : len(at)]
    dense = np.zeros((SLICES, int(at[-1]) + 1), np.uint8)
    dense[:, at] = packed
    return [int.from_bytes(row.tobytes(), "little") for row in np.packbits(dense, axis=1, bitorder="little")]


def lowest(bitmap: int, k: int) -> list[int]:
    """The first k places of a bitmap."""
    places = []
    while bitmap and len(places) < k:
        bit = bitmap & -bitmap
        places.append(bit.bit_length() - 1)
        bitmap ^= bit
    return places


def top(total: list[int], k: int) -> list[tuple[int, int]]:
    """(place, score) of the k highest scores above 0, ties by place, found from the most significant slice down."""
    sure, open_ = 0, 0
    for x in total:
        open_ |= x
    if open_.bit_count() > k:
        for x in reversed(total):
            with_bit = sure | open_ & x
            n = with_bit.bit_count()
            if n > k:
                open_ &= x
            else:
                sure = with_bit
                open_ &= ~x
                if n == k:
                    open_ = 0
                    break
    places = lowest(sure, k)
    places += lowest(open_, k - len(places))
    return [(p, sum((x >> p & 1) << b for b, x in enumerate(total))) for p in places]


def search(index: DataFrame, queries: DataFrame, k: int = 50, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score) of each query's k best documents."""
    spark = index.sparkSession
    terms = queries.select(F.col(id_col).alias("item_id"), F.explode(F.array_distinct(F.regexp_extract_all(lower_ascii(F.col(text_col)), F.lit(PLAIN_WORD), F.lit(0)))).alias("term"))
    # Numbers of one partition are consecutive, so a block holds at most BLOCK queries.
    numbered = save(terms.select("item_id").distinct().withColumn("item", F.monotonically_increasing_id()), "queries")
    same = F.col("t.item_id").eqNullSafe(F.col("q.item_id"))
    wanted = save(terms.alias("t").join(numbered.alias("q"), same).select("item", "term").distinct().withColumn("block", F.floor(F.col("item") / BLOCK)), "query-terms")

    n = index.where("term = ''").agg(F.sum("holders").cast("long")).first()[0] or 0
    frequency = index.select("term", "holders").join(wanted.select("term").distinct(), "term").groupBy("term").agg(F.sum("holders").cast("long").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n) + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weights = frequency.select("term", weight.alias("weight")).where("weight > 0")
    blocks = wanted.join(weights, "term").groupBy("block", "term", "weight").agg(F.collect_list("item").alias("items"))
    ids = wanted.select("block", F.lit("").alias("term"), F.lit(0).cast("long").alias("weight"), F.array().cast("array<long>").alias("items")).distinct()
    asked = save(blocks.unionByName(ids), "query-blocks")
    held = index.join(asked, "term").select("shard", "block", "weight", "items", "places", "slices", "ids")

    def run(group: pa.Table) -> pa.Table:
        ids, totals = None, {}
        for row in group.column("ids"):
            ids = row.as_py() if row.is_valid else ids
        for items, weight, places, slices in zip(group.column("items"), group.column("weight"), group.column("places"), group.column("slices"), strict=True):
            if places.is_valid:
                score = times(spread(places.as_py(), slices.as_py()), weight.as_py())
                for item in items.as_py():
                    totals[item] = add(totals.get(item, []), score)
        found = [(item, ids[place], score) for item, total in totals.items() for place, score in top(total, k)]
        item, doc, score = zip(*found, strict=True) if found else ((), (), ())
        return pa.table({"item": pa.array(item, pa.int64()), "doc_id": pa.array(doc, pa.int64()), "score": pa.array(score, pa.int64())})

    ship(spark)
    best = held.groupBy("shard", "block").applyInArrow(run, "item long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(numbered, "item").select("item_id", "rank", "doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = rf"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{PLAIN_WORD}')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
lengths AS (SELECT doc_id, CAST(sum(tf) AS bigint) AS n FROM tf GROUP BY doc_id),
whole AS (SELECT count(*) AS docs, CAST(sum(n) AS bigint) AS terms FROM lengths),
m AS (SELECT doc_id, 50 + (50 * n * docs) // terms AS m FROM lengths, whole),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{PLAIN_WORD}')) AS term FROM benchmark),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS double) / CAST(2 * count(*) + 1 AS double))) AS bigint) AS w FROM tf, whole GROUP BY term, docs),
scores AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS bigint) AS score
  FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id)
SELECT * FROM (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS integer) AS rank, doc_id, score FROM scores WHERE score > 0) WHERE rank <= 50
"""
