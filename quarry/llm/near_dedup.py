"""Near-duplicate documents by SetSketch registers (operator 5).

1. ``sketches``: each text's set of distinct 5-word shingles is hashed to 64 bits and folded into
   ``REGISTERS`` registers. Register i keeps the smallest of the shingles' exponential variables on an
   exponential scale, ``floor(1 - log_b(min))`` truncated to 16 bits; sketches merge by register-wise
   maximum. A shingle's variables are the first arrivals of one Poisson process whose points are dealt
   out over the registers, so only the early points are ever drawn.
2. Texts with equal sets form one *class*, numbered when the table of classes is written; classes, not copies and not
   ids, are compared from here on.
3. Registers are banded (``BANDS`` bands of ``ROWS``); equal bands put classes in one bucket. Each bucket's
   smallest class is its star: members are first compared with it alone. Pairs whose joint likelihood
   estimate of the similarity is below ``threshold - MARGIN`` are dropped, the others are checked on the full sets.
4. Links give components (``components``). Buckets that still hold several components are compared
   whole, block by block: estimates mark the members that have a plausible partner in another
   component, and these members' full sets are then compared in the same blocks. Nothing is capped: a
   large bucket only makes more pairs of blocks, each a bounded piece of work, and pairs inside one
   component, which could add nothing, are passed over.

The chance that a pair at the threshold shares no band is (1 - 0.85^8)^40, some 3 in a million.

Sets are recomputed only for classes that share a bucket, written once, and joined by class. All
joins are on class, its key or bucket, so that adaptive execution may split a hot one; aggregations combine on the map
side. Intermediate tables live in the shared folder, so a lost executor costs a task, not the job.

Defined results: null and empty texts have no shingles and stand alone; a text of 1 to 4 words has
its whole word sequence as its only shingle; texts of any length are read whole, one at a time in a task. Rows with a
null id are not linked (component null) and are kept. Every row is judged by its own text: repeated rows fall into one class and count
as one document, and if one id has several texts each row has the component of its own. An empty table gives an
empty result. Only id and text are read, so other columns may bear any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import map_arrow, save, space_words, table, text_bytes

SHINGLE = 5
#: Link when 100 * intersection >= PERCENT * union.
PERCENT = 85
ROWS, BANDS = 8, 40
REGISTERS = ROWS * BANDS
#: Scale of the registers: base, rate and largest value, as 16-bit registers allow.
BASE, RATE, TOP = 1.001, 20.0, 65534
#: A pair is dropped unseen only if its estimate is this far below the threshold: at 320 registers
#: the estimate's standard error near the threshold is 0.02.
MARGIN = 0.09
#: Members and shingles of a block of a bucket.
BLOCK, BLOCK_SHINGLES = 512, 1_000_000
#: Classes whose links a task contracts at a time.
HELD = 200_000
GROUP = ["bucket", "i", "j"]
MIX = np.uint64(0x9E3779B97F4A7C15)


def _scramble(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x + MIX
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: bytes, words: Words) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    tokens = space_words(text)
    if not tokens:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens))
    n = max(1, len(h) - SHINGLE + 1)
    mixed = np.zeros(n, np.uint64)
    for j in range(min(SHINGLE, len(h))):
        mixed = _scramble(mixed ^ h[j : j + n])
    return np.unique(mixed)


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """Registers of many sets at once; an empty set has all registers 0."""
    sizes = np.array([len(s) for s in sets])
    found = np.full((len(sets), REGISTERS), np.inf)
    todo = np.flatnonzero(sizes)
    # All points before this time are drawn; a set of which a register stays empty is drawn longer.
    horizon = (np.log(REGISTERS) + 4) / np.maximum(sizes, 1)
    while len(todo):
        for part in np.array_split(todo, max(1, int(sizes[todo].sum()) // 200_000)):
            owner = np.repeat(part, sizes[part])
            state = np.concatenate([sets[i] for i in part])
            time = np.zeros(len(state))
            until = horizon[owner]
            while len(state):
                state = _scramble(state)
                time = time - np.log1p(-((state >> np.uint64(11)).astype(float) * 2.0**-53)) / REGISTERS
                alive = time < until
                owner, state, time, until = owner[alive], state[alive], time[alive], until[alive]
                register = (_scramble(state ^ MIX) % np.uint64(REGISTERS)).astype(np.int64)
                np.minimum.at(found, (owner, register), time)
        todo = todo[np.isinf(found[todo]).any(axis=1)]
        found[todo] = np.inf
        horizon[todo] *= 2
    with np.errstate(divide="ignore"):
        values = np.floor(1 - np.log(found * RATE / REGISTERS) / np.log(BASE))
    return np.clip(np.where(np.isinf(found), 0, values + TOP // 2), 0, TOP).astype(np.uint16)


def bands(registers: np.ndarray) -> np.ndarray:
    """One 64-bit bucket per band."""
    cut = registers.reshape(len(registers), BANDS, ROWS).astype(np.uint64)
    mixed = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), cut.shape[:2])
    for j in range(ROWS):
        mixed = _scramble(mixed ^ cut[:, :, j])
    return mixed


def _curve(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)


def similarity(above: np.ndarray, below: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Maximum likelihood estimate of the similarity of pairs.

    ``above`` and ``below`` count registers in which the first is greater or less. The estimate is sought
    on a grid from 0.5 up, for only pairs near the threshold matter; lower similarities come out as 0.5.
    """
    grid = np.linspace(0.5, 1, 101)[:, None]
    u, v = size_a / (size_a + size_b), size_b / (size_a + size_b)
    possible = np.minimum(grid, np.minimum(u / v, v / u))
    up, down = _curve(u - v * possible), _curve(v - u * possible)
    same = REGISTERS - above - below
    with np.errstate(divide="ignore", invalid="ignore"):
        likely = (
            np.where(above > 0, above * np.log(np.maximum(up, 1e-12)), 0)
            + np.where(below > 0, below * np.log(np.maximum(down, 1e-12)), 0)
            + np.where(same > 0, same * np.log(np.maximum(1 - up - down, 1e-12)), 0)
        )
    return possible[likely.argmax(axis=0), np.arange(likely.shape[1])]


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, class_key, registers`` per row; both binary columns are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingles(t, words) for t in text_bytes(part.column("t"))]
                found = sketch(sets)
                keys = [_set_key(s) for s in sets]
                registers = [r.tobytes() if len(s) else None for r, s in zip(found, sets, strict=True)]
                arrays = [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(registers, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_shingles", "class_key", "registers"])

    columns = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    return map_arrow(columns, run, "doc_id long, n_shingles long, class_key binary, registers binary")


def _banded(classes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                values = np.frombuffer(b"".join(part.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS)
                buckets = bands(values)
                ids = np.repeat(part.column("class").to_numpy(), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(buckets.ravel().view(np.int64)), pa.array(ids)], ["bucket", "class"])

    return map_arrow(classes.select("class", "registers"), run, "bucket long, class long")


def _likely(pairs: DataFrame, classes: DataFrame, floor: float) -> DataFrame:
    """Pairs (a, b) whose estimate is at least ``floor``."""
    side = lambda x: classes.select(F.col("class").alias(x), F.col("n").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("r_a", "r_b"))
            sizes = [batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b")]
            good = similarity((x > y).sum(axis=1), (x < y).sum(axis=1), *sizes) >= floor if len(x) else np.zeros(0, bool)
            mask = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    return map_arrow(pairs.join(side("a"), "a").join(side("b"), "b"), run, "a long, b long")


def linked(x: bytes, y: bytes, percent: int) -> bool:
    """Whether two full sets are similar enough."""
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets meet the threshold."""
    side = lambda x: sets.select(F.col("class").alias(x), F.col("shingles").alias(f"s_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(batch.column("s_a"), batch.column("s_b"), strict=True)
            mask = pa.array([linked(x.as_py(), y.as_py(), percent) for x, y in sides], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    return map_arrow(pairs.join(side("a"), "a").join(side("b"), "b"), run, "a long, b long")


def _contracted(links: DataFrame) -> DataFrame:
    """Links (class, other) that join the same classes with less: what a task reads is replaced by links to each group's smallest class.

    A task holds ``HELD`` links at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}

        def top(c: int) -> int:
            while root.setdefault(c, c) != c:
                root[c] = c = root[root[c]]
            return c

        def told() -> pa.RecordBatch:
            return _pairs([(c, top(c)) for c in root if top(c) != c], ["class", "other"])

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                x, y = sorted((top(a), top(b)))
                root[y] = x
            if len(root) > HELD:
                yield told()
                root.clear()
        if root:
            yield told()

    return map_arrow(links.select("a", "b"), run, "class long, other long")


def components(links: DataFrame) -> DataFrame:
    """``class, component``: the smallest class reachable, for every class with a link.

    Links are first contracted where they lie. Then each round a class takes the smallest label around it, and the label of that
    label; rounds end when no label changes.
    """
    short = _contracted(links)
    edges = save(short.union(short.select("other", "class")).filter("class <> other").distinct(), "edges")
    labels = save(edges.groupBy("class").agg(F.least("class", F.min("other")).alias("component")), "labels")
    while True:
        around = edges.join(labels.select(F.col("class").alias("other"), "component"), "other").select("class", "component", F.lit(None).cast("long").alias("old"))
        own = labels.select("class", "component", F.col("component").alias("old"))
        stepped = around.unionByName(own).groupBy("class").agg(F.min("component").alias("c"), F.max("old").alias("old"))
        above = labels.select(F.col("class").alias("c"), F.col("component").alias("up"))
        jumped = save(stepped.join(above, "c", "left").select("class", "old", F.least("c", F.coalesce("up", "c")).alias("component")), "labels")
        labels = jumped.select("class", "component")
        if jumped.filter("component <> old").isEmpty():
            return labels


def _grouped(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Tables of rows with one key, from batches sorted by the key; a key may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy() for k in key])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            now = tuple(keys[:, a].tolist())
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def _blocked(members: DataFrame, columns: DataFrame) -> DataFrame:
    """``members`` (bucket, class, component) joined with ``columns`` by class and dealt out as pairs of blocks.

    A bucket is cut into blocks of about ``BLOCK`` members and ``BLOCK_SHINGLES`` shingles; each pair of blocks is a
    group of its own, so a bucket of any size is compared in bounded pieces.
    """
    known = members.join(columns, "class")
    cut = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int")
    sizes = members.join(columns.select("class", "n"), "class").groupBy("bucket").agg(cut.alias("blocks"))
    own = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    dealt = known.join(sizes, "bucket").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("blocks", "other")
    return rows.repartition(*GROUP).sortWithinPartitions(*GROUP)


def _plausible(group: pa.Table, floor: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, other rows, estimates) of a group: pairs of different components with an estimate of at least ``floor``."""
    registers = np.frombuffer(b"".join(group.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS)
    ids, comps, n, side = (group.column(c).to_numpy() for c in ("class", "component", "n", "own"))
    bucket, i, j = (group.column(c)[0].as_py() for c in GROUP)
    mine = bands(registers)
    this = int(np.flatnonzero(mine[0] == np.int64(bucket).view(np.uint64))[0])
    left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
    for x in left:
        others = right[(comps[right] != comps[x]) & ((ids[right] > ids[x]) if i == j else True)]
        # A pair that shares an earlier band is compared in that band's bucket.
        others = others[~(mine[others, :this] == mine[x, :this]).any(axis=1)]
        if not len(others):
            continue
        above, below = (registers[x] > registers[others]).sum(axis=1), (registers[x] < registers[others]).sum(axis=1)
        rough = REGISTERS - above - below >= (floor - 0.1) * REGISTERS
        others, above, below = others[rough], above[rough], below[rough]
        if not len(others):
            continue
        guess = similarity(above, below, np.full(len(others), float(n[x])), n[others].astype(float))
        good = guess >= floor
        if good.any():
            yield x, others[good], guess[good]


def _pairs(rows: list[tuple[int, int]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], names)


def _undecided(members: DataFrame, classes: DataFrame, floor: float) -> DataFrame:
    """(bucket, class) of members that have a plausible partner in another component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int]] = []
        for group in _grouped(batches, GROUP):
            marked: set[int] = set()
            for x, others, _ in _plausible(group, floor):
                marked |= {int(x), *others.tolist()}
            bucket, ids = group.column("bucket")[0].as_py(), group.column("class").to_numpy()
            held += [(bucket, int(ids[k])) for k in marked]
            if len(held) > 10_000:
                yield _pairs(held, ["bucket", "class"])
                held = []
        if held:
            yield _pairs(held, ["bucket", "class"])

    return map_arrow(_blocked(members, classes), run, "bucket long, class long").distinct()


def _joined(members: DataFrame, classes: DataFrame, sets: DataFrame, floor: float, percent: int) -> DataFrame:
    """Links (a, b) between components, checked on the full sets that lie beside the sketches.

    Within a group likelier pairs come first, and pairs that the group's own links have joined are passed over.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int]] = []
        for group in _grouped(batches, GROUP):
            pairs = [(-g, int(x), y) for x, others, guess in _plausible(group, floor) for y, g in zip(others.tolist(), guess.tolist(), strict=True)]
            ids, comps = group.column("class").to_numpy(), group.column("component").to_pylist()
            shingled = group.column("shingles")
            root = {c: c for c in comps}

            def top(c: int, root: dict[int, int] = root) -> int:
                while root[c] != c:
                    root[c] = c = root[root[c]]
                return c

            for _, x, y in sorted(pairs):
                a, b = top(comps[x]), top(comps[y])
                if a != b and linked(shingled[x].as_py(), shingled[y].as_py(), percent):
                    root[a] = b
                    held.append((int(ids[x]), int(ids[y])))
            if len(held) > 10_000:
                yield _pairs(held, ["a", "b"])
                held = []
        if held:
            yield _pairs(held, ["a", "b"])

    return map_arrow(_blocked(members, classes.join(sets, "class")), run, "a long, b long")


def judged(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, class_key, group, component_id, kept`` per row of ``docs``.

    ``class_key`` names the text's set (null without words), ``group`` numbers its component's classes; ``component_id`` is the
    smallest id among the group's rows.
    """
    floor = percent / 100 - MARGIN
    rows = save(sketches(docs, id_col, text_col), "sketches")
    usable = rows.filter("doc_id is not null and class_key is not null")
    grouped = usable.groupBy("class_key").agg(
        F.min("doc_id").alias("least"), F.max("doc_id").alias("greatest"),
        F.first("n_shingles").alias("n"), F.first("registers").alias("registers"),
    )
    # The number is fixed by being written: every later step reads this table.
    classes = save(grouped.withColumn("class", F.monotonically_increasing_id()), "classes")
    compared = classes.select("class", "n", "registers")

    buckets = save(_shared(_banded(classes)), "buckets")
    stars = buckets.filter("class <> star").select(F.col("class").alias("a"), F.col("star").alias("b")).distinct()
    wanted = buckets.select("class").distinct().join(classes.select("class", "class_key", "least"), "class")
    sets = save(_sets(docs, wanted, id_col, text_col), "sets")

    links = save(_verified(_likely(stars, compared, floor), sets, percent), "links")
    reached = components(links)
    members = _divided(buckets, reached)
    undecided = save(_undecided(members, compared, floor), "undecided")
    if not undecided.isEmpty():
        again = members.join(undecided, ["bucket", "class"], "left_semi")
        more = save(_joined(again, compared, sets, floor, percent), "links")
        reached = components(links.union(more))

    # Only linked classes and those of several ids differ from their rows' own ids.
    named = save(classes.select("class_key", "class", "least", "greatest").join(reached, "class"), "named")
    least = named.groupBy("component").agg(F.min("least").alias("id"))
    linked_ = named.join(least, "component").select("class_key", F.col("component").alias("group"), "id")
    alone = classes.filter("least <> greatest").join(reached, "class", "left_anti").select("class_key", F.col("class").alias("group"), F.col("least").alias("id"))
    joined = rows.select("doc_id", "n_shingles", "class_key").join(linked_.union(alone), "class_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("id", "doc_id"))
    return joined.select(
        "doc_id", "n_shingles", "class_key", "group", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def near_duplicates(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row of ``docs``."""
    return judged(docs, percent, id_col, text_col).select("doc_id", "n_shingles", "component_id", "kept")


def _shared(banded: DataFrame) -> DataFrame:
    """(bucket, class, star) for buckets with several classes."""
    stars = banded.groupBy("bucket").agg(F.min("class").alias("star"), F.max("class").alias("last")).filter("star <> last")
    return banded.join(stars.select("bucket", "star"), "bucket")


def _divided(buckets: DataFrame, reached: DataFrame) -> DataFrame:
    """(bucket, class, component) for buckets whose classes are of several components."""
    members = buckets.select("bucket", "class").join(reached, "class", "left").select("bucket", "class", F.coalesce("component", "class").alias("component"))
    members = save(members, "members")
    divided = members.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high")
    return members.join(divided.select("bucket"), "bucket")


def _set_key(shingled: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(shingled.tobytes()) if len(shingled) else None


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``class, shingles``: the full set of each wanted class (class, class_key, least), read from the texts of its least id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                sets = [shingles(t, words) for t in text_bytes(batch.slice(at, 500).column("t"))]
                arrays = [pa.array([_set_key(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["class_key", "shingles"])

    texts = docs.select(F.col(id_col).cast("long").alias("least"), F.col(text_col).alias("t")).filter("t is not null")
    read = texts.join(wanted.select("least"), "least", "left_semi").select("t")
    # An id may have other texts as well; a set is known by its key.
    return map_arrow(read, run, "class_key binary, shingles binary").dropDuplicates(["class_key"]).join(wanted.select("class", "class_key"), "class_key").select("class", "shingles")


def _keyed(docs: DataFrame) -> DataFrame:
    """``row, class_key`` of rows of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                keys = [_set_key(shingles(t, words)) for t in text_bytes(part.column("t"))]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(keys, pa.binary())], ["row", "class_key"])

    columns = docs.select(F.struct("*").alias("row"), F.col("text").alias("t"))
    return map_arrow(columns, run, columns.select("row").schema.add("class_key", "binary"))


def keep(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each component, with its columns as they were.

    Rows that share id and text (null is empty) count as one document, of which the row that is least as JSON stays. An id's other texts are judged
    for themselves. Rows without words are no copies of each other; rows with a null id stay as they are.

    Texts move once, in the join with the ids that go, which is a merge join at any size, for these ids grow with the
    corpus. Ids that occur more than once are written first: where there are none or few the planner sees it from
    the table's size, and spares their join the shuffle. Only their rows are read for their sets again.
    """
    found = save(judged(docs, percent).filter("doc_id is not null"), "judged")
    verdicts = found.groupBy("doc_id").agg(F.bool_and("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    verdicts = save(verdicts.filter("n > 1 or not kept"), "verdicts")
    several = save(verdicts.filter("n > 1").select("doc_id"), "repeated")
    rest = docs.join(verdicts.select("doc_id").hint("merge"), "doc_id", "left_anti").select(docs.columns)
    if several.isEmpty():
        return rest

    # Of an id's kept texts in one group the one with the least key stays.
    staying = found.join(several, "doc_id", "left_semi").filter("kept and class_key is not null")
    staying = staying.groupBy("doc_id", F.coalesce("group", F.xxhash64("class_key")).alias("group")).agg(F.min("class_key").alias("class_key"))
    keyed = _keyed(docs.join(several, "doc_id", "left_semi").select(docs.columns)).withColumn("doc_id", F.col("row.doc_id").cast("long"))
    known = keyed.filter("class_key is not null").join(staying.select("doc_id", "class_key").distinct(), ["doc_id", "class_key"], "left_semi")
    kept = known.unionByName(keyed.filter("class_key is null"))
    text = F.sha2(F.coalesce(F.col("row.text"), F.lit("")), 256)
    once = kept.groupBy("doc_id", "class_key", F.when(F.col("class_key").isNull(), text).alias("blank")).agg(F.min_by("row", F.to_json("row")).alias("row"))
    return rest.unionByName(once.select("row.*").select(docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: DuckDB SQL for query(): all pairs that share a shingle, on the driver's small tables.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS g FROM d, unnest(range(1, greatest(2, len(w) - 3))) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 85 * (a.n + b.n - shared)),
r(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
