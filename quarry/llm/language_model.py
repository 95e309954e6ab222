"""Language-model scores from a log-bilinear model (operator 8).

Counts: every word of every training text is counted (a task counts its words, Spark adds up), which
gives the base score ``sum log10((c + 1) / (N + V + 1))``. A word is known by 64 bits: 57 of its hash and
7 of its *class*, a number made from its first letters.

Model: a symbol is a *head*, the end, or the class of any other word. Heads are all words that occur ``HEAD_COUNT``
times or more, so their number grows with the corpus (at least the ``HEADS`` and at most the ``MAX_HEADS`` most frequent words).
Symbols are ordered by frequency and cut into about as many groups as a group has symbols, by equal sums of the roots of
their shares and an even part (so none has more than ``2 * sqrt(symbols) + 1``). The log-bilinear network predicts the next symbol's group, then the symbol within its group, from the vectors of the two
symbols before: ``s(x | u, v) = (C1[v] + C2[u]) . R[x] + b[x]``. Both levels are trained in numpy by noise-contrastive estimation,
against the groups' and the group's own symbol counts. Normalisers of both levels come from batched matrix products, so
probabilities are exact and a token costs about ``2 * sqrt(symbols)`` products. Within a class a word has
``(c + 1) / (class tokens + class words + 1)``; heads and classes with their words and one unknown word each sum to 1.

Training texts are dealt by a hash of id and text to shards, one per ``SHARD_TOKENS`` training tokens (at most ``SHARDS``), and read
in the order of that hash; every shard takes one pass from the same start, and the shards' parameters are
averaged by tokens in the order of shards. So the fit depends on the rows alone, not on how the input is split.

Words with at least the cut-off count are looked up in a broadcast table of at most ``TOP`` entries;
the cut-off is read from a histogram of counts, so it is exact at any size. The rare words of a text
(a tenth of all tokens here) are kept with the text's row, and joined with the table of rare counts.
Rows bear a number of their own through that join, so equal ids do not mix.

Defined results: null and empty texts consist of the end alone. Without training texts the counts are 0 and the
model is uniform over its symbols; an empty table gives an empty result. Texts of any length are read whole, some ``CHUNK`` tokens at a time.
Columns other than id and text are not read, whatever their names. Repeated rows and null ids are scored row by row; a null id is not held out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import crc_mod, map_arrow, save, space_words, table, text_bytes

HEADS = 384
HEAD_COUNT = 200
MAX_HEADS = 16_384
CLASSES = 128
DIM = 16
TOP = 200_000
#: Leading bits by which names are looked up.
LEADING = 20
NOISE = 32
BATCH = 4096
RATE = 0.05
BLOCKS = 256
SHARD_TOKENS = 4_000_000
SHARDS = 8192
#: Tokens handled at a time in a task.
CHUNK = 400_000
MEMO = 1_000_000
#: Tokens scored by one product, few enough for their scores to stay in a core's cache, and scores of which exponentials can be summed as they are.
SCORED = 1024
SAFE = 80


class Words(dict):
    """64-bit names of words, remembered up to a bound; the low 7 bits are the class."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO:
            self.clear()
        name = self[word] = name_of(word)
        return name

    def text(self, text: bytes) -> np.ndarray:
        """Names of the text's words and of the end."""
        words = space_words(text)
        found = np.empty(len(words) + 1, np.uint64)
        found[:-1] = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        found[-1] = END
        return found


WORDS = Words()


def kept_words() -> Words:
    """The names of this worker, which last from task to task; a function sent to a worker would bring a copy of its own of the object."""
    return WORDS


def name_of(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) & ~127 | zlib.crc32(word[:2]) % CLASSES


#: No word contains a space.
END = name_of(b" ")


def chunks(texts: list[bytes], words: Words) -> Iterator[list[np.ndarray]]:
    """Named texts, together some ``CHUNK`` tokens at a time."""
    held, size = [], 0
    for text in texts:
        names = words.text(text)
        held.append(names)
        size += len(names)
        if size > CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``name, c`` over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = kept_words()
        for batch in batches:
            held: list[tuple[np.ndarray, np.ndarray]] = []
            for named in chunks(text_bytes(batch.column("t")), words):
                held.append(np.unique(np.concatenate(named), return_counts=True))
            if held:
                names, inverse = np.unique(np.concatenate([n for n, _ in held]), return_inverse=True)
                counts = np.bincount(inverse, weights=np.concatenate([c for _, c in held])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(counts)], ["name", "c"])

    counted = map_arrow(docs.select(F.col(text_col).alias("t")), run, "name long, c long")
    return counted.groupBy("name").agg(F.sum("c").alias("c"))


class Vocabulary:
    """The frequent words with their counts, the symbols in order of frequency, and the groups they are cut into."""

    def __init__(self, names: np.ndarray, counts: np.ndarray, ends: int, class_rows: list[tuple[int, int, int]]):
        order = np.argsort(names)
        self.names, self.counts = names[order], counts[order]
        # Where the names begin that have the same leading bits, or greater ones.
        self.begins = np.r_[0, np.bincount((self.names >> np.uint64(64 - LEADING)).astype(np.int64), minlength=1 << LEADING).cumsum()].astype(np.int32)
        words = np.lexsort((self.names, -self.counts))
        words = words[self.names[words] != END]
        frequent = int((self.counts[words] >= HEAD_COUNT).sum())
        heads = words[: min(max(frequent, HEADS), MAX_HEADS)]
        tokens, types = np.zeros(CLASSES), np.zeros(CLASSES)
        for cls, n, v in class_rows:
            tokens[cls], types[cls] = n, v
        self.n, self.v = int(tokens.sum()) + ends, int(types.sum()) + (ends > 0)
        classes = (self.names & np.uint64(127)).astype(int)
        np.subtract.at(tokens, classes[heads], self.counts[heads])
        np.subtract.at(types, classes[heads], 1)
        mass = np.r_[self.counts[heads], ends, tokens] + 0.5
        by_mass = np.argsort(-mass, kind="stable")
        rank = np.empty(len(mass), np.int32)
        rank[by_mass] = np.arange(len(mass))
        self.prior = mass[by_mass] / mass.sum()
        self.end, self.class_symbol = rank[len(heads)], rank[len(heads) + 1 :]
        self.symbol = self.class_symbol[classes]
        self.symbol[heads] = rank[: len(heads)]
        self.symbol[self.names == END] = self.end
        self.in_class, self.class_log = np.zeros(len(mass), bool), np.zeros(len(mass))
        self.in_class[self.class_symbol] = True
        self.class_log[self.class_symbol] = np.log10(tokens + types + 1)

    def look_up(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the table (or -1) and symbols."""
        symbols = self.class_symbol[(names & np.uint64(127)).astype(int)]
        found = np.full(len(names), -1)
        if len(self.names):
            lead = (names >> np.uint64(64 - LEADING)).astype(np.int32)
            at, past = self.begins[lead], self.begins[lead + 1]
            # Names of the same leading bits are few; each round tries the next of them for all that are left.
            left = np.flatnonzero(at < past)
            while len(left):
                tried = at[left]
                same = self.names[tried] == names[left]
                hit = left[same]
                found[hit] = tried[same]
                symbols[hit] = self.symbol[tried[same]]
                left = left[~same]
                at[left] += 1
                left = left[at[left] < past[left]]
        symbols[names == END] = self.end
        return found, symbols


def stream(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Texts laid end to end, each after two ends, and the places of their tokens."""
    lead = np.full(2, END, np.uint64)
    joined = np.concatenate([x for t in texts for x in (lead, t)])
    sizes = np.array([len(t) + 2 for t in texts])
    starts = np.cumsum(sizes) - sizes
    places = np.ones(len(joined), bool)
    places[starts] = places[starts + 1] = False
    return joined, np.flatnonzero(places)


class Bilinear:
    """Context vectors of symbols, and output vectors of groups (level 0) and of symbols (level 1)."""

    def __init__(self, prior: np.ndarray):
        size, rng = len(prior), np.random.default_rng(5)
        roots = np.sqrt(prior)
        share = (roots / roots.sum() + 1 / size).cumsum()
        cuts = np.searchsorted(share, share[-1] * np.arange(1, int(np.ceil(np.sqrt(size)))) / np.ceil(np.sqrt(size)))
        self.edges = np.unique(np.r_[0, cuts, size])
        self.group = np.repeat(np.arange(len(self.edges) - 1), np.diff(self.edges))
        masses = np.add.reduceat(prior, self.edges[:-1])
        self.prior = [masses, prior / masses[self.group]]
        self.shapes = [(size, DIM), (size, DIM), (len(masses), DIM), (size, DIM), (len(masses),), (size,)]
        vectors = [rng.normal(0, 0.05, shape) for shape in self.shapes[:4]]
        self.place([*vectors, np.log(self.prior[0]), np.log(self.prior[1])])
        self.speed = [np.full(shape, 1e-6, np.float32) for shape in self.shapes]

    def place(self, parts: list[np.ndarray]) -> None:
        self.parts = [p.astype(np.float32) for p in parts]
        self.near, self.far = self.parts[:2]
        self.out, self.bias = self.parts[2:4], self.parts[4:]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts])

    def load(self, flat: np.ndarray) -> None:
        ends = np.cumsum([np.prod(shape) for shape in self.shapes])[:-1]
        self.place([p.reshape(shape) for p, shape in zip(np.split(flat, ends), self.shapes, strict=True)])

    def learn(self, grams: np.ndarray, weights: np.ndarray, rng: np.random.Generator) -> None:
        """One pass over (before last, last, next) symbols with their counts, group by group and for the groups themselves."""
        fars, nears, nexts = (np.ascontiguousarray(column) for column in grams.T)
        target = self.group[nexts]
        work = [(0, 0, at) for at in np.array_split(rng.permutation(len(grams)), len(grams) // BATCH + 1)]
        order = ordered(target)
        for g, at in zip(np.unique(target), np.split(order, np.flatnonzero(np.diff(target[order])) + 1), strict=True):
            if self.edges[g + 1] - self.edges[g] > 1:
                work += [(1, g, part) for part in np.array_split(rng.permutation(at), len(at) // BATCH + 1)]
        for i in rng.permutation(len(work)):
            level, g, at = work[i]
            far, near, word = fars[at], nears[at], nexts[at]
            if level:
                self._step(far, near, word - self.edges[g], weights[at], 1, slice(self.edges[g], self.edges[g + 1]), rng)
            else:
                self._step(far, near, target[at], weights[at], 0, slice(None), rng)

    def _step(self, far, near, word, weight, level: int, span: slice, rng: np.random.Generator) -> None:
        """One step of noise-contrastive estimation; ``word`` counts from the beginning of ``span``."""
        prior, out, bias = self.prior[level][span], self.out[level][span], self.bias[level][span]
        noise = rng.choice(len(prior), NOISE, p=prior / prior.sum())
        offset = bias - np.log(NOISE * prior).astype(np.float32)
        hidden = np.take(self.near, near, axis=0)
        hidden += np.take(self.far, far, axis=0)
        own = np.einsum("bd,bd->b", hidden, np.take(out, word, axis=0)) + offset[word]
        other = hidden @ out[noise].T + offset[noise]
        weight = weight / weight.sum()
        miss = (1 / (1 + np.exp(np.minimum(-own, 30))) - 1) * weight
        np.exp(np.minimum(np.negative(other, out=other), 30, out=other), out=other)
        other += 1
        false = np.divide(weight[:, None], other, out=other)
        told = np.take(out, word, axis=0)
        told *= miss[:, None]
        told += false @ out[noise]
        # Vectors and biases are reached by the same symbols; the last column is the bias's.
        reached = np.empty((len(word) + NOISE, DIM + 1), np.float32)
        np.multiply(hidden, miss[:, None], out=reached[: len(word), :DIM])
        reached[: len(word), DIM] = miss
        np.matmul(false.T, hidden, out=reached[len(word) :, :DIM])
        reached[len(word) :, DIM] = false.sum(axis=0)
        rows, grad = summed(np.r_[word, noise] + (span.start or 0), reached)
        self._move(2 + level, rows, grad[:, :DIM])
        self._move(4 + level, rows, grad[:, DIM])
        self._move(0, *summed(near, told))
        self._move(1, *summed(far, told))

    def _move(self, part: int, rows: np.ndarray, grad: np.ndarray) -> None:
        """Moves distinct rows against the sums of their values, slower the more they have moved."""
        speed = self.speed[part][rows] + grad * grad
        self.speed[part][rows] = speed
        self.parts[part][rows] -= RATE * grad / np.sqrt(speed)

    def log_probabilities(self, far: np.ndarray, near: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Natural logarithms of the next symbols' probabilities."""
        # Equal triples are scored once, and the groups once for equal contexts, which stand together.
        size = len(self.group)
        grams, inverse = np.unique((far.astype(np.int64) * size + near) * size + word, return_inverse=True)
        far, near, word = grams // size**2, grams // size % size, grams % size
        target, found = self.group[word], np.empty(len(word))
        starts = np.flatnonzero(np.diff(grams // size, prepend=-1))
        for first in range(0, len(starts), SCORED):
            at = starts[first : first + SCORED]
            end = starts[first + SCORED] if first + SCORED < len(starts) else len(grams)
            row = np.repeat(np.arange(len(at)), np.diff(at, append=end))
            found[at[0] : end] = self._normalised(far[at], near[at], row, target[at[0] : end], 0, slice(None))
        order = ordered(target)
        for same in np.split(order, np.flatnonzero(np.diff(target[order])) + 1) if len(order) else ():
            first, last = self.edges[target[same[0]]], self.edges[target[same[0]] + 1]
            for at in np.split(same, range(SCORED, len(same), SCORED)) if last - first > 1 else ():
                found[at] += self._normalised(far[at], near[at], np.arange(len(at)), word[at] - first, 1, slice(first, last))
        return found[inverse]

    def _normalised(self, far, near, row, word, level: int, span: slice) -> np.ndarray:
        """Logarithms of what follows the contexts; the ``row`` of a word is its context."""
        out, bias = self.out[level][span], self.bias[level][span]
        # One product adds the bias as well: the last component of a context is 1.
        hidden = np.empty((len(near), DIM + 1), np.float32)
        np.add(np.take(self.near, near, axis=0), np.take(self.far, far, axis=0), out=hidden[:, :DIM])
        hidden[:, DIM] = 1
        weights = np.concatenate([out, bias[:, None]], axis=1)
        score = hidden @ weights.T
        # No product is larger than that of the lengths; within it exponentials are summed as they are, else a common term is taken off.
        if not np.einsum("bd,bd->b", hidden, hidden).max() * np.einsum("bd,bd->b", weights, weights).max() < SAFE**2:
            score -= score.max(axis=1, keepdims=True)
        own = score[row, word]
        return own - np.log(np.exp(score, out=score) @ np.ones(score.shape[1], np.float32))[row]


def summed(symbols: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct symbols, and the sums of their values."""
    order = ordered(symbols)
    sorted_symbols = symbols[order]
    new = np.empty(len(symbols), bool)
    new[0] = True
    np.not_equal(sorted_symbols[1:], sorted_symbols[:-1], out=new[1:])
    starts = np.flatnonzero(new)
    return sorted_symbols[starts], np.add.reduceat(np.take(values, order, axis=0), starts, axis=0)


def ordered(symbols: np.ndarray) -> np.ndarray:
    """The stable order of symbols or groups; 16-bit numbers are sorted by radix."""
    short = np.uint16 if len(symbols) and symbols.max() < 1 << 16 else symbols.dtype
    return np.argsort(symbols.astype(short), kind="stable")


def train(docs: DataFrame, vocabulary, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray | None:
    """Parameters after one pass by every shard over its texts, averaged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary.value
        model, words, rng, tokens = Bilinear(vocab.prior), kept_words(), np.random.default_rng(9), 0
        size = len(vocab.prior)
        for batch in batches:
            for named in chunks(text_bytes(batch.column("t")), words):
                names, places = stream(named)
                symbols = vocab.look_up(names)[1].astype(np.int64)
                grams = (symbols[places - 2] * size + symbols[places - 1]) * size + symbols[places]
                grams, counts = np.unique(grams, return_counts=True)
                split = np.stack([grams // size**2, grams // size % size, grams % size], axis=1)
                model.learn(split, counts.astype(np.float32), rng)
                tokens += len(places)
        if tokens:
            parts = np.array_split(model.flat(), BLOCKS)
            shard = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(BLOCKS), pa.int32()), pa.array([shard] * BLOCKS, pa.int32()),
                    pa.array([tokens] * BLOCKS, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary()),
                ],
                ["block", "shard", "tokens", "part"],
            )

    def averaged(group: pa.Table) -> pa.Table:
        group = group.sort_by("shard")
        weights = group.column("tokens").to_numpy().astype(float)
        total, mean = weights.sum(), 0.0
        for part, weight in zip(group.column("part"), weights, strict=True):
            mean = mean + np.frombuffer(part.as_py(), np.float32) * (weight / total)
        return pa.table({"block": group.column("block").slice(0, 1), "part": pa.array([mean.astype(np.float32).tobytes()], pa.binary())})

    shards = max(1, min(SHARDS, -(-vocabulary.value.n // SHARD_TOKENS)))
    dealt = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("k"), F.col(text_col).alias("t")).repartition(shards, "k").sortWithinPartitions("k")
    # A group holds one small piece of each shard's parameters.
    trained = map_arrow(dealt.select("t"), run, "block int, shard int, tokens long, part binary")
    rows = trained.groupBy("block").applyInArrow(averaged, "block int, part binary").collect()
    if not rows:
        return None
    return np.concatenate([np.frombuffer(r.part, np.float32) for r in sorted(rows, key=lambda r: r.block)])


def is_end():
    return F.col("name") == F.lit(END - (1 << 64) if END >= 1 << 63 else END)


def _vocabulary(counts: DataFrame) -> tuple[Vocabulary, int]:
    """The broadcast part of the counts, and the least count in it."""
    level = F.floor(F.log2("c") * 8).cast("int")
    histogram = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("level")).collect()
    cut, size = 1 << 20, 0
    for row in histogram:
        if size + row.n > TOP:
            break
        cut, size = row.level, size + row.n
    top = counts.filter((level >= cut) | is_end()).toArrow()
    low = F.col("name").bitwiseAND(F.lit(127)).alias("cls")
    classes = [tuple(r) for r in counts.filter(~is_end()).groupBy(low).agg(F.sum("c"), F.count(F.lit(1))).collect()]
    names, found = top.column("name").to_numpy().view(np.uint64), top.column("c").to_numpy()
    return Vocabulary(names, found, int(found[names == END].sum()), classes), cut


def fit(training: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int, Broadcast, Bilinear]:
    """The counts of all words, the least count in the broadcast vocabulary, that vocabulary, and the network."""
    counts = save(word_counts(training, text_col), "counts")
    vocab, cut = _vocabulary(counts)
    vocabulary = training.sparkSession.sparkContext.broadcast(vocab)
    model = Bilinear(vocab.prior)
    trained = train(training, vocabulary, id_col, text_col)
    if trained is not None:
        model.load(trained)
    return counts, cut, vocabulary, model


def score(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` per row of ``docs``."""
    counts, cut, vocabulary, model = fit(training, id_col, text_col)
    vocab = vocabulary.value
    fitted = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, model, words = vocabulary.value, fitted.value, kept_words()
        log_all, log_count = np.log10(vocab.n + vocab.v + 1), np.log10(vocab.counts + 1)
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            first = 0
            for named in chunks(text_bytes(batch.column("t")), words):
                names, places = stream(named)
                at, symbols = vocab.look_up(names)
                at, names = at[places], names[places]
                u, v, w = symbols[places - 2], symbols[places - 1], symbols[places]
                model_log = model.log_probabilities(u, v, w) / np.log(10)
                sizes = np.array([len(t) for t in named])
                starts = np.cumsum(sizes) - sizes
                known = at >= 0
                logs = np.where(known, log_count[at] if len(log_count) else 0, 0)
                model_log += np.where(vocab.in_class[w], logs - vocab.class_log[w], 0)
                rare = np.split(names[~known].view(np.int64), np.cumsum(np.add.reduceat(~known, starts))[:-1])
                arrays = [
                    batch.column("doc_id").slice(first, len(named)),
                    pa.array(number + np.arange(len(named))),
                    pa.array(sizes),
                    pa.array(np.add.reduceat(known.astype(np.int64), starts)),
                    pa.array(np.add.reduceat(logs, starts) - sizes * log_all),
                    pa.array(np.add.reduceat(model_log, starts)),
                    pa.array([x.tolist() for x in rare], pa.list_(pa.int64())),
                ]
                number += len(named)
                first += len(named)
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "row", "n_tokens", "known", "base", "model", "rare"])

    columns = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    schema = "doc_id long, row long, n_tokens long, known long, base double, model double, rare array<bigint>"
    rows = save(map_arrow(columns, run, schema), "scored")
    level = F.floor(F.log2("c") * 8).cast("int")
    rare = rows.select("row", F.explode("rare").alias("name")).join(counts.filter((level < cut) & ~is_end()), "name")
    more = rare.groupBy("row").agg(F.count(F.lit(1)).alias("more"), F.sum(F.log10(F.col("c") + 1)).alias("logs"))
    return rows.drop("rare").join(more, "row", "left").select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(vocab.n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("logs", F.lit(0.0))).alias("base_score"),
        (F.col("model") + F.coalesce("logs", F.lit(0.0))).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    training = docs.filter(crc_mod("doc_id", 7) != 2)
    scored = score(docs, training)
    return scored.select("doc_id", (crc_mod("doc_id", 7) == 2).alias("held_out"), *scored.columns[1:])
