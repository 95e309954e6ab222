"""Toxicity scores from a convolutional text classifier trained in numpy (operator 4).

Words (plain words, A-Z lower-cased) and their stems (first characters) are hashed to 2^20 buckets.
Buckets seen often enough among the training texts get an embedding, all others the zero vector; a
word's vector is the sum of both, so that inflected words share what their stem has taught. Filters of widths 1, 2 and 3 run
over the embedded words, each filter keeps its maximum over the whole text, and a logistic layer
reads the maxima. Training is plain numpy with Adam; since only the place of a maximum receives a
gradient, a step costs little. The first embedding dimension starts at the bucket's smoothed
log-odds, so that rare but telling words reach the maxima from the first step on.

A width-w filter is a sum of w projections of single words; scoring therefore looks words up in
one projected table per filter place and needs no matrix product per text.

Training data: at most ``sample`` labelled rows (half per class where there are enough), chosen by
a hash of the id, from the labels alone; it is a documented bound of the fit. A fifth of them
calibrates the scores (Platt) and gives each language its threshold: of all thresholds with the best
F1, the one nearest to ``DEFAULT_THRESHOLD``. The language chooses only the threshold of
``flagged``; neither it nor source, id or labels enter a score.

Scoring is one narrow stage over whole texts; the broadcast model is bounded by ``ROWS``.

Defined results: null or empty texts are scored as texts without words. Labels without id or
value are ignored, several labels of one id count as toxic if one is; of an id's several texts the one that sorts first is
learned. Texts of any length are learned and scored whole; the sample is bounded in rows, so its texts must fit one task.
An empty table gives an empty result; columns other than id, text and lang are not read, whatever their names. Without both classes among
the labels every text scores the share of toxic labels (0 without labels). Repeated rows and null
ids are scored row by row.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import crc_mod, map_arrow, plain_words, table, text_bytes

BUCKETS = 1 << 20
ROWS = 60_000
DIM = 8
WIDTHS = {1: 8, 2: 6, 3: 6}
SAMPLE = 8_000
EPOCHS = 2
#: Characters of a word that make its stem.
STEM = 4
DEFAULT_THRESHOLD = 0.3
MEMO = 1_000_000
#: Words scored at a time, to bound a task's memory whatever the length of a text.
CHUNK = 200_000


class Hasher(dict):
    """Word to the buckets of the word and its stem, packed; remembers what it has seen up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO:
            self.clear()
        stem = word.decode(errors="replace")[:STEM].encode()
        pair = self[word] = (zlib.crc32(word) & (BUCKETS - 1)) << 32 | (zlib.crc32(stem, 1) & (BUCKETS - 1))
        return pair

    def text(self, text: bytes) -> np.ndarray:
        words = plain_words(text)
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Embeddings, filters and the logistic layer; ``rows`` maps a bucket to its embedding row, 0 for none."""

    def __init__(self, rows: np.ndarray, n_rows: int, odds: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.rows = rows
        self.embedding = rng.normal(0, 0.1, (n_rows, DIM)).astype(np.float32)
        self.embedding[:, 0] = odds
        self.embedding[0] = 0
        self.filters = {w: rng.normal(0, 0.1, (w, DIM, n)).astype(np.float32) for w, n in WIDTHS.items()}
        self.filters[1][0, :, 0] = 0
        self.filters[1][0, 0, 0] = 0.5
        self.bias = np.zeros(sum(WIDTHS.values()), np.float32)
        self.out = rng.normal(0, 0.1, len(self.bias)).astype(np.float32)
        self.out[0] = 1
        self.constant = np.float32(-2)
        self.scale, self.shift = 1.0, 0.0

    def freeze(self) -> None:
        self.tables = {w: [self.embedding @ f[j] for j in range(w)] for w, f in self.filters.items()}

    def looked_up(self, text: np.ndarray) -> np.ndarray:
        return self.rows[np.stack([text >> 32, text & 0xFFFFFFFF])]

    def _maxima(self, ids: np.ndarray, starts: np.ndarray, upto: int | None = None) -> np.ndarray:
        """Filter maxima of texts laid end to end, each followed by three neutral words; ``upto``: filters start before it."""
        found = []
        for w, tables in self.tables.items():
            response = tables[0][ids[0]] + tables[0][ids[1]]
            for j in range(1, w):
                response[:-j] += tables[j][ids[0, j:]]
                response[:-j] += tables[j][ids[1, j:]]
            found.append(np.maximum.reduceat(response[:upto], starts, axis=0))
        return np.hstack(found) + self.bias

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """Scores of texts given as packed bucket arrays."""
        pad = np.zeros((2, 3), np.int32)
        maxima = np.empty((len(texts), len(self.bias)), np.float32)
        first, held, size = 0, [], 0

        def flush(upto: int) -> None:
            nonlocal held, size, first
            if held:
                starts = np.cumsum([0, *(x.shape[1] for x in held[:-1])])
                maxima[first:upto] = self._maxima(np.concatenate(held, axis=1), starts)
            held, size, first = [], 0, upto

        for i, text in enumerate(texts):
            ids = self.looked_up(text)
            if len(text) > CHUNK:  # piece by piece, with the words that filters reach across
                flush(i)
                padded = np.concatenate([ids, pad], axis=1)
                parts = [self._maxima(padded[:, a : a + CHUNK + 2], np.array([0]), CHUNK) for a in range(0, padded.shape[1], CHUNK)]
                maxima[i] = np.max(np.vstack(parts), axis=0)
                first = i + 1
                continue
            held.append(np.concatenate([ids, pad], axis=1))
            size += len(text) + 3
            if size > CHUNK:
                flush(i + 1)
        flush(len(texts))
        logit = np.maximum(maxima, 0) @ self.out + self.constant
        return sigmoid(logit.astype(np.float64) * self.scale + self.shift)


def train(texts: list[np.ndarray], labels: np.ndarray, langs: list[str], share: float) -> tuple[Network | None, dict[str, float]]:
    """``share``: of toxic texts among all labelled ones, which the sample need not have. Returns a calibrated network and the thresholds by language, or (None, {}) without two classes."""
    if len(texts) < 10 or len(set(labels.tolist())) < 2:
        return None, {}
    fit = np.arange(len(texts)) % 5 != 0
    if len(set(labels[fit].tolist())) < 2:
        fit[:] = True
    n_pos, n_neg = int(labels[fit].sum()), int((~labels[fit].astype(bool)).sum())
    seen = [np.unique(np.concatenate([t >> 32, t & 0xFFFFFFFF])) for t, f in zip(texts, fit, strict=True) if f]
    with_toxic = np.bincount(np.concatenate([s for s, y in zip(seen, labels[fit], strict=True) if y] or [np.zeros(0, int)]), minlength=BUCKETS)
    with_clean = np.bincount(np.concatenate([s for s, y in zip(seen, labels[fit], strict=True) if not y] or [np.zeros(0, int)]), minlength=BUCKETS)
    del seen
    both, prior = with_toxic + with_clean, n_pos / (n_pos + n_neg)
    order = np.argsort(-both, kind="stable")[:ROWS]
    order = order[both[order] >= 2]
    rows = np.zeros(BUCKETS, np.int32)
    rows[order] = np.arange(1, len(order) + 1)
    toxic = (with_toxic[order] + 8 * prior) / (both[order] + 8)
    odds = np.log(toxic / (1 - toxic)) - np.log(prior / (1 - prior))
    net = Network(rows, len(order) + 1, np.concatenate([[0], odds]).astype(np.float32))
    _descend(net, [t for t, f in zip(texts, fit, strict=True) if f], labels[fit].astype(np.float32))
    net.freeze()
    rest = ~fit if len(set(labels[~fit].tolist())) == 2 else fit
    raw = net.score([t for t, r in zip(texts, rest, strict=True) if r])
    net.scale, net.shift = _platt(np.log(raw / (1 - raw)), labels[rest], share)
    calibrated = net.score([t for t, r in zip(texts, rest, strict=True) if r])
    found = {}
    for lang in sorted({x for x, r in zip(langs, rest, strict=True) if r and x is not None}):
        own = np.array([x == lang for x, r in zip(langs, rest, strict=True) if r])
        if labels[rest][own].sum() >= 5:
            found[lang] = _threshold(calibrated[own], labels[rest][own])
    return net, found


def _descend(net: Network, texts: list[np.ndarray], labels: np.ndarray, rate: float = 0.01, batch: int = 64) -> None:
    rng = np.random.default_rng(11)
    dense = {"out": net.out, "bias": net.bias, **{f"f{w}": f for w, f in net.filters.items()}}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in dense.items()}
    moved, speed = np.zeros_like(net.embedding), np.zeros_like(net.embedding)
    step = 0
    pad = np.zeros((2, 3), np.int32)
    weight = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum())) * len(labels)
    for _ in range(EPOCHS):
        for at in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // batch)):
            step += 1
            parts = [np.concatenate([net.looked_up(texts[i]), pad], axis=1) for i in at]
            starts = np.cumsum([0, *(x.shape[1] for x in parts[:-1])])
            ids = np.concatenate([*parts, pad], axis=1)
            n = ids.shape[1]
            ends = np.append(starts[1:], n - 3)
            words = net.embedding[ids[0]] + net.embedding[ids[1]]
            maxima, places = [], []
            for w, f in net.filters.items():
                response = sum(words[j : n - 3 + j] @ f[j] for j in range(w))
                where = np.stack([a + response[a:b].argmax(axis=0) for a, b in zip(starts, ends, strict=True)])
                places.append(where)
                maxima.append(np.take_along_axis(response, where, axis=0))
            hidden = np.maximum(pre := np.hstack(maxima) + net.bias, 0)
            error = (sigmoid(hidden @ net.out + net.constant) - labels[at]) * weight[at] / len(at)
            back = np.outer(error, net.out) * (pre > 0)
            grads = {"out": hidden.T @ error + 1e-4 * net.out, "bias": back.sum(axis=0)}
            touched, pushed, offset = [], [], 0
            for (w, f), where in zip(net.filters.items(), places, strict=True):
                own = back[:, offset : offset + f.shape[2]]
                offset += f.shape[2]
                grads[f"f{w}"] = np.stack([np.einsum("bkd,bk->dk", words[where + j], own) for j in range(w)])
                for j in range(w):
                    for k in (0, 1):
                        touched.append(ids[k][where + j].ravel())
                        pushed.append((own[:, :, None] * f[j].T[None]).reshape(-1, DIM))
            for k, v in dense.items():
                m, s = moments[k]
                m += 0.1 * (grads[k] - m)
                s += 0.001 * (grads[k] ** 2 - s)
                v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
            net.constant -= np.float32(rate * 10 * error.sum())
            rows, inverse = np.unique(np.concatenate(touched), return_inverse=True)
            grad = np.zeros((len(rows), DIM), np.float32)
            np.add.at(grad, inverse, np.concatenate(pushed))
            moved[rows] = 0.9 * moved[rows] + 0.1 * grad
            speed[rows] = 0.99 * speed[rows] + 0.01 * grad**2
            net.embedding[rows] -= 0.5 * rate * moved[rows] / (np.sqrt(speed[rows]) + 1e-6)
            net.embedding[0] = 0


def _platt(logit: np.ndarray, labels: np.ndarray, share: float) -> tuple[float, float]:
    """Scale and shift of logits by penalised Newton steps, with the classes weighed as among all labels."""
    labels = labels.astype(float)
    x = np.column_stack([logit, np.ones_like(logit)])
    weight = np.where(labels == 1, share / max(1, labels.sum()), (1 - share) / max(1, (1 - labels).sum())) * len(labels)
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = sigmoid(x @ theta)
        grad = x.T @ ((p - labels) * weight) + 0.5 * (theta - [1, 0])
        hess = (x * (p * (1 - p) * weight)[:, None]).T @ x + 0.5 * np.eye(2)
        theta = theta - np.clip(np.linalg.solve(hess, grad), -1, 1)
    return (float(theta[0]), float(theta[1])) if theta[0] > 0 else (1.0, 0.0)


def _threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    grid = np.arange(5, 96) / 100
    best = []
    for cut in grid:
        said = scores >= cut
        hit = (said & (labels == 1)).sum()
        best.append(2 * hit / max(1, said.sum() + labels.sum()))
    good = grid[np.array(best) >= max(best) - 1e-9]
    return float(good[np.argmin(np.abs(good - DEFAULT_THRESHOLD))])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"):
    """Train on a bounded sample of labelled rows; returns (network, thresholds, share of toxic labels)."""
    valued = labels.select(F.col("doc_id").alias("i"), F.col("toxic").alias("y")).filter("i is not null and y is not null")
    known = valued.groupBy("i").agg((F.max("y") > 0).cast("int").alias("y"))
    ranked = [known.filter(F.col("y") == y).orderBy(F.xxhash64("i"), "i").limit(sample // 2) for y in (1, 0)]
    chosen = ranked[0].unionByName(ranked[1])  # at most `sample` ids, the bound of the broadcast
    lang = F.col(lang_col) if lang_col in docs.columns else F.lit(None).cast("string")
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), lang.alias("lang")).join(F.broadcast(chosen), "i")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            ids = pa.array([hasher.text(t).tobytes() for t in text_bytes(batch.column("t"))], pa.binary())
            one = pa.array(np.zeros(batch.num_rows, np.int32))
            yield pa.RecordBatch.from_arrays([one, batch.column("i"), batch.column("y"), batch.column("lang"), ids], ["one", "i", "y", "lang", "ids"])

    def trained(sample: pa.Table) -> pa.Table:
        sample = sample.sort_by("i")
        order = np.random.default_rng(3).permutation(sample.num_rows)
        ids, langs = sample.column("ids"), sample.column("lang").to_pylist()
        arrays = [np.frombuffer(ids[int(i)].as_py(), np.int64) for i in order]
        fitted = train(arrays, sample.column("y").to_numpy()[order].astype(int), [langs[i] for i in order], share)
        return pa.table({"model": pa.array([pickle.dumps(fitted)], pa.binary())})

    classes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = classes.get(1, 0) / max(1, sum(classes.values()))
    # A repeated id is trained on once, of several texts on that with the least numbers. The sample, bucket numbers of 8 bytes a word, is the one group of a task;
    # the driver sees the model alone.
    hashed_texts = map_arrow(texts.select("i", "y", "lang", "t"), hashed, "one int, i long, y int, lang string, ids binary")
    once = hashed_texts.groupBy("one", "i").agg(F.min(F.struct("ids", "y", "lang")).alias("r")).select("one", "i", "r.y", "r.lang", "r.ids")
    found = once.groupBy("one").applyInArrow(trained, "model binary").collect()
    net, thresholds = pickle.loads(found[0].model) if found else (None, {})
    return net, thresholds, share


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", carry: bool = False) -> DataFrame:
    """``doc_id, score, threshold, flagged`` per row; with ``carry`` the input row as ``row``."""
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(model)
    row = [F.struct("*").alias("row")] if carry else []
    lang = F.col(lang_col) if lang_col in docs.columns else F.lit(None).cast("string")
    columns = docs.select(F.col(id_col).cast("long").alias("doc_id"), lang.alias("lang"), F.col(text_col).alias("t"), *row)
    kept = [f for f in columns.schema.fields if f.name in ("doc_id", "row")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, thresholds, share = shared.value
        hasher = Hasher()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = text_bytes(part.column("t"))
                scores = net.score([hasher.text(t) for t in texts]) if net else np.full(len(texts), share)
                cuts = np.array([thresholds.get(x, DEFAULT_THRESHOLD) for x in part.column("lang").to_pylist()], float)
                arrays = [part.column(f.name) for f in kept] + [pa.array(scores, pa.float64()), pa.array(cuts, pa.float64()), pa.array(scores >= cuts)]
                yield pa.RecordBatch.from_arrays(arrays, [f.name for f in kept] + ["score", "threshold", "flagged"])

    schema = columns.select([f.name for f in kept]).schema.add("score", "double").add("threshold", "double").add("flagged", "boolean")
    return map_arrow(columns, run, schema)


def training_labels(labels: DataFrame) -> DataFrame:
    return labels.filter(crc_mod("doc_id", 4) != 2)


def keep(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of ``docs`` below their language's threshold, with their columns as they were."""
    model = fit(docs, training_labels(table(spark, sf_dir, "labels")))
    return score(docs, model, carry=True).filter(~F.col("flagged")).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, training_labels(table(spark, sf_dir, "labels")))
    return score(docs, model).select(
        "doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score",
        F.when(F.col("score") >= DEFAULT_THRESHOLD, 1).otherwise(0).alias("predicted"), "threshold", "flagged",
    )
