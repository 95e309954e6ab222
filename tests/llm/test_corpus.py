"""Archives, near-duplicates, mixing, language model, decontamination and the pipeline against brute force."""

import collections
import gzip
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import decontamination, language_model, mixing, near_dedup, toxicity, warc
from quarry.llm.common import crc_mod, shared_dir

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# --- archives


def test_archives_round_trip(spark):
    rows = [(1, "http://a", b"same"), (5, "http://b", b"same"), (3, "http://c\r\nX: y", b"same"), (2, None, None), (4, "d", b""), (None, "e", b"same"), (7, "f", b"\x00\xff\r\n\r\n" * 50_000), (8, "g", b"x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, payload binary").repartition(3)
    folder = f"{shared_dir(spark)}/warc-test"
    manifest = warc.write(warc.roles(pages), folder)
    assert manifest.agg(F.sum("records")).first()[0] == len(rows)
    got = {r.page_id: r for r in warc.read(manifest, folder).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {
        1: ("revisit", 5), 3: ("revisit", 5), None: ("revisit", 5), 5: ("response", None), 2: ("revisit", 4), 4: ("response", None), 7: ("response", None), 8: ("response", None),
    }
    assert bytes(got[7].payload) == rows[6][2] and got[1].payload_bytes == 4 and got[1].payload_digest == got[5].payload_digest == warc.digest_of(b"same")
    assert got[3].url == "http://c%0D%0AX:%20y" and got[2].url is None
    longer = {r.page_id: r.refers_to for r in warc.roles(pages, min_bytes=4).collect()}
    assert longer[1] == 5 and longer[2] is None
    nothing = warc.write(warc.roles(pages.limit(0)), folder)
    assert warc.read(nothing, folder).count() == 0


def test_reader_takes_pieces_of_any_size_and_refuses_broken_archives():
    raw = [warc.record(i, "u", bytes([i]) * (1000 * i), None if i % 2 else 9) for i in range(5)]
    archive = b"".join(map(warc.member, raw))
    assert gzip.decompress(archive) == b"".join(raw)
    for size in (1, 7, 1000, 1 << 20):
        pieces = iter([archive[a : a + size] for a in range(0, len(archive), size)])
        assert [h["WARC-Record-ID"] for h, _ in warc.read_records(pieces)] == [f"<urn:page:{i}>" for i in range(5)]
    with pytest.raises(warc.Broken):
        list(warc.read_records(iter([archive[:-5]])))
    with pytest.raises(warc.Broken):
        list(warc.read_records(iter([warc.member(raw[1].replace(b"\x01" * 10, b"\x02" * 10, 1))])))


# --- near-duplicates


def brute_components(rows, percent=85):
    sets = {}
    for i, text in rows:
        w = SPACE.findall(lower(text))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for a in ids:
        for b in ids:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: (len(sets[i]), top(i)) for i in sets}


def test_near_duplicates_are_exact(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(500)]
    rows, base = [], list(rng.choice(words, 60))
    for i in range(150):  # one group of copies, each with some changed words
        copy = list(base)
        for place in rng.integers(0, 60, rng.integers(0, 4)):
            copy[place] = rng.choice(words)
        rows.append((i, " ".join(copy)))
    rows += [(200 + i, " ".join(rng.choice(words, 30))) for i in range(40)]
    rows += [(300 + i, rows[i][1].upper()) for i in range(5)] + [(400, ""), (401, None), (402, "a b c"), (403, "A  b\nc")]
    near_dedup.BLOCK, kept = 16, near_dedup.BLOCK
    try:
        got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    finally:
        near_dedup.BLOCK = kept
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_sketches_merge_by_maximum():
    rng = np.random.default_rng(2)
    a, b = (np.unique(rng.integers(0, 1 << 60, 200).astype(np.uint64)) for _ in range(2))
    x, y, both = near_dedup.sketch([a, b, np.union1d(a, b)])
    assert (np.maximum(x, y) == both).all()


def test_near_duplicates_take_odd_rows(odd_docs, no_docs):
    got = near_dedup.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert [r.kept for r in got if r.doc_id is None] == [True]
    kept = near_dedup.keep(odd_docs)
    assert kept.columns == odd_docs.columns
    assert collections.Counter(r.doc_id for r in kept.collect()) == {1: 1, 2: 1, None: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 2}
    assert near_dedup.near_duplicates(no_docs).count() == 0 and near_dedup.keep(no_docs).count() == 0


def test_near_duplicates_judge_rows_by_their_own_text(spark):
    a, b = "one text that others copy word for word", "another text that nobody has copied at all"
    schema = "doc_id long, text string, extra string"
    rows = [(1, a, "x"), (5, b, "x"), (5, a, "x"), (7, b + " x1 x2", "z"), (7, b + " x1 x2", "y"), (9, "", "p"), (9, None, "p"), (9, "", "p"), (9, " ", "p"), (None, a, "n"), (None, a, "n")]
    docs = spark.createDataFrame(rows, schema).repartition(4)
    found = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).filter("n_shingles > 0 and doc_id < 7").collect()}
    assert found == {(1, 4, 1, True), (5, 4, 5, True), (5, 4, 1, False)}
    kept = sorted(map(tuple, near_dedup.keep(docs).collect()), key=repr)
    assert kept == sorted([(1, a, "x"), (5, b, "x"), (7, b + " x1 x2", "y"), (9, None, "p"), (9, " ", "p"), (None, a, "n"), (None, a, "n")], key=repr)


def test_one_of_an_id_s_linked_texts_stays(spark):
    words = [f"w{i}" for i in range(60)]
    near = [" ".join(words), " ".join([*words[:-1], "other"]), " ".join([*words, "more"])]
    other = " ".join(reversed(words))
    docs = spark.createDataFrame([(3, near[0]), (3, near[1]), (3, other), (8, near[2])], "doc_id long, text string")
    kept = sorted(map(tuple, near_dedup.keep(docs).collect()))
    assert len(kept) == 2 and kept[0][0] == kept[1][0] == 3 and other in {t for _, t in kept}


# --- decontamination


def test_fm_index_on_random_runs():
    rng = np.random.default_rng(0)
    for _ in range(100):
        runs = [rng.integers(1, 4, rng.integers(1, 40)) for _ in range(rng.integers(1, 8))]
        text = np.concatenate([x for r in runs for x in (r, [0])]).astype(np.int32)
        index = decontamination.FMIndex(text, 5)
        phrases = [rng.integers(1, 5, rng.integers(1, 6)).tolist() for _ in range(20)]
        rows = np.zeros((20, 6), np.int32)
        for row, p in zip(rows, phrases):
            row[6 - len(p) :] = p
        low, high = index.search(rows, np.array([len(p) for p in phrases]))
        for k, p in enumerate(phrases):
            want = [i for i in range(len(text)) if text[i : i + len(p)].tolist() == p]
            found = index.locate(np.arange(low[k], high[k])) if high[k] > low[k] else np.array([])
            assert sorted(found.tolist()) == want


def brute_hits(text, items):
    words = PLAIN.findall(lower(text))
    hit, ids = set(), set()
    for item, own in items:
        w = PLAIN.findall(lower(own))
        for window in {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w and item is not None else ():
            for i in range(len(words) - len(window) + 1):
                if tuple(words[i : i + len(window)]) == window:
                    hit |= set(range(i, i + len(window)))
                    ids.add(item)
    return len(words), sorted(hit), sorted(ids)


@pytest.mark.parametrize("block, index", [(200_000, 1 << 19), (3, 1 << 19), (200_000, 12)])
def test_decontamination_is_exact(spark, odd_docs, monkeypatch, block, index):
    monkeypatch.setattr(decontamination, "BLOCK", block)
    monkeypatch.setattr(decontamination, "INDEX", index)
    rng = np.random.default_rng(5)
    words = ["the", "quick", "brown", "fox", "é", "ñandú"]
    items = [(i, " ".join(rng.choice(words, n))) for i, n in enumerate([15, 12, 3, 1, 10, 30])] + [(8, None), (9, " !"), (None, "the fox"), (2, "word word"), (6, "SHORT one"), (7, "short ONE!")]
    docs = [(i, " ".join(rng.choice(words, 200)) + " X " + items[i % 6][1] + ", end") for i in range(12)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    both = spark.createDataFrame(docs, "doc_id long, text string").unionByName(odd_docs.select("doc_id", "text"))
    for r in decontamination.search(both, benchmark, carry=True).collect():
        n, hit, ids = brute_hits(r.row.text, items)
        assert (r.n_words, sorted(k for s in r.spans for k in range(s.start, s.end)), r["items"]) == (n, hit, ids)
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))


@pytest.mark.parametrize("size, block", [(1 << 20, 200_000), (50, 7)])
def test_a_stored_index_finds_what_brute_force_finds(spark, odd_docs, monkeypatch, size, block):
    monkeypatch.setattr(decontamination, "INDEX", size)
    monkeypatch.setattr(decontamination, "BLOCK", block)
    rng = np.random.default_rng(6)
    words = ["a", "b", "c", "d", "É", "7"]
    items = [(i, " ".join(rng.choice(words, n))) for i, n in enumerate([3, 10, 11, 14, 1, 10])] + [(6, ""), (7, None), (None, "a b"), (0, "a B"), (9, "unheard words only")]
    docs = [(i, " ".join(rng.choice(words, int(rng.integers(0, 300)))) + " X " + items[i % 6][1] + ", end") for i in range(12)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    both = spark.createDataFrame(docs, "doc_id long, text string").unionByName(odd_docs.select("doc_id", "text"))
    index = decontamination.build_index(both.repartition(3))
    got = sorted((r.doc_id or 0, r.n_words, sorted(k for s in r.spans for k in range(s.start, s.end)), r["items"]) for r in decontamination.search_index(index, benchmark).collect())
    assert got == sorted((r.doc_id or 0, *brute_hits(r.text, items)) for r in both.collect())
    # The same index serves another benchmark, and none.
    other = spark.createDataFrame([(1, "d d d")], "item_id long, text string")
    assert sorted((r.doc_id or 0, len(r["items"])) for r in decontamination.search_index(index, other).collect()) == sorted((r.doc_id or 0, len(brute_hits(r.text, [(1, "d d d")])[2])) for r in both.collect())
    assert decontamination.search_index(index, benchmark.limit(0)).filter("size(spans) > 0").count() == 0
    assert decontamination.search_index(decontamination.build_index(both.limit(0)), benchmark).count() == 0


def test_decontamination_without_benchmark_or_documents(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    found = decontamination.search(odd_docs, none).collect()
    assert all(not r.spans and not r["items"] for r in found) and sum(r.n_words for r in found) > 30_000
    some = spark.createDataFrame([(1, "short one")], "item_id long, text string")
    assert decontamination.search(no_docs, some).count() == 0
    kept = decontamination.keep(odd_docs, some)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 1


# --- language model


def test_base_scores_are_exact_and_probabilities_sum_to_one(spark, odd_docs, monkeypatch):
    rows = odd_docs.select("doc_id", "text").collect()
    tokens = [(r.doc_id, SPACE.findall(lower(r.text)) + [" "]) for r in rows]
    counts = collections.Counter()
    for i, t in tokens:
        if zlib.crc32(str(i).encode() if i is not None else b"") % 7 != 2:
            counts.update(t)
    n, v = sum(counts.values()), len(counts)
    for top in (200_000, 3):
        monkeypatch.setattr(language_model, "TOP", top)
        got = language_model.score(odd_docs, odd_docs.filter(crc_mod("doc_id", 7) != 2)).collect()
        key = lambda r: (r[0] or 0, r[1], round(r[-1], 4))
        want = sorted(((i, len(t), sum(counts[w] > 0 for w in t), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t)) for i, t in tokens), key=key)
        for r, w in zip(sorted(got, key=lambda r: (r.doc_id or 0, r.n_tokens, round(r.base_score, 4))), want, strict=True):
            assert (r.doc_id, r.n_tokens, r.n_known, r.train_tokens) == w[:4] and math.isclose(r.base_score, w[4], rel_tol=1e-9)
            assert r.score < 0


def test_model_beats_the_base_on_held_out_text(spark, sf):
    scored = language_model.query(spark, sf).filter("held_out").agg(F.sum("base_score").alias("base"), F.sum("score").alias("score")).first()
    assert scored.score > scored.base


def test_scores_equal_a_plain_scorer(spark, sf):
    """Every token's probability from loops over the parameters, with counts of the words themselves."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("length(text) < 4000")
    training = docs.filter(crc_mod("doc_id", 7) != 2)
    _, _, vocabulary, model = language_model.fit(training)
    vocab, counts = vocabulary.value, collections.Counter()
    for r in training.collect():
        counts.update(SPACE.findall(lower(r.text)) + [" "])
    classes = collections.defaultdict(lambda: [0, 0])
    known = dict(zip(vocab.names.tolist(), vocab.symbol.tolist(), strict=True))

    def symbol(word):
        name = language_model.name_of(word.encode())
        return vocab.end if word == " " else known.get(name, vocab.class_symbol[name & 127])

    for w, c in counts.items():
        if vocab.in_class[symbol(w)]:
            classes[symbol(w)][0] += c
            classes[symbol(w)][1] += 1

    def softmax(u, v, out, bias, own):
        hidden = [float(x) + float(y) for x, y in zip(model.near[v], model.far[u], strict=True)]
        scores = [math.exp(sum(h * float(o) for h, o in zip(hidden, row, strict=True)) + float(b)) for row, b in zip(out, bias, strict=True)]
        return scores[own] / sum(scores)

    got = {r.doc_id: r.score for r in language_model.score(docs, training).collect()}
    texts = {r.doc_id: r.text for r in docs.orderBy("doc_id").limit(8).collect()}
    for i, text in texts.items():
        want, u, v = 0.0, vocab.end, vocab.end
        for word in [*SPACE.findall(lower(text)), " "]:
            w = symbol(word)
            g = int(model.group[w])
            first, last = model.edges[g], model.edges[g + 1]
            want += math.log10(softmax(u, v, model.out[0], model.bias[0], g))
            want += math.log10(softmax(u, v, model.out[1][first:last], model.bias[1][first:last], w - first))
            if vocab.in_class[w]:
                want += math.log10((counts[word] + 1) / (sum(classes[w]) + 1))
            u, v = v, w
        assert math.isclose(got[i], want, rel_tol=1e-4), (i, got[i], want)


def test_scores_do_not_depend_on_the_split(spark, sf, monkeypatch):
    monkeypatch.setattr(language_model, "SHARD_TOKENS", 20_000)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    few, many = ({r.doc_id: r for r in language_model.score(d, d.filter(crc_mod("doc_id", 7) != 2)).collect()} for d in (docs.repartition(4), docs.repartition(64, "lang", "doc_id")))
    assert few.keys() == many.keys()
    for i, r in few.items():
        assert r[:4] == many[i][:4] and math.isclose(r.score, many[i].score, rel_tol=1e-5)


def test_symbols_grow_with_the_corpus():
    words = sorted((w for w in map(language_model.name_of, (f"w{i}".encode() for i in range(30_000)))), key=str)
    names = np.array(words, np.uint64)
    sizes = []
    for common in (100, 1_000, 5_000, 29_000):
        counts = np.r_[np.full(common, 1_000), np.ones(len(names) - common, int)]
        classes = (names & np.uint64(127)).astype(int)
        rows = [(k, int(counts[classes == k].sum()), int((classes == k).sum())) for k in range(language_model.CLASSES)]
        vocab = language_model.Vocabulary(names, counts, 50, rows)
        sizes.append(len(vocab.prior) - 1 - language_model.CLASSES)
        model = language_model.Bilinear(vocab.prior)
        assert np.diff(model.edges).max() <= 2 * math.sqrt(len(vocab.prior)) + 1 and math.isclose(vocab.prior.sum(), 1)
        u, v = np.full(len(vocab.prior), 3), np.full(len(vocab.prior), 9)
        assert math.isclose(np.exp(model.log_probabilities(u, v, np.arange(len(vocab.prior)))).sum(), 1, rel_tol=1e-3)
    assert sizes == [language_model.HEADS, 1_000, 5_000, language_model.MAX_HEADS]


def test_language_model_without_texts(odd_docs, no_docs):
    assert language_model.score(no_docs, odd_docs).count() == 0
    blank = language_model.score(odd_docs, no_docs).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 and r.score < 0 for r in blank)


# --- mixing


def test_mixture_meets_its_targets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    target = spark.createDataFrame([("en", 1.0), ("de", 1.0), ("fr", 1.0), ("es", 1.0)], "lang string, weight double")
    mixed = mixing.mix(docs, {"lang": target}).cache()
    cells = mixed.select("source", "lang", "topic", "weight").distinct()
    # The last dimension raked holds exactly, the others nearly.
    assert all(abs(r.w - 0.25) < 0.05 for r in cells.groupBy("lang").agg(F.sum("weight").alias("w")).collect())
    assert abs(cells.agg(F.sum("weight")).first()[0] - 1) < 1e-6
    total, expected = mixed.agg(F.sum("n_tokens"), F.sum(F.col("n_tokens") * F.col("p"))).first()
    assert expected <= total * mixing.SHARE * 1.0001
    assert mixed.filter("p < 0 or p > 1").count() == 0


def test_mixing_takes_odd_rows(odd_docs, no_docs):
    mixed = mixing.mix(odd_docs, carry=True)
    assert mixed.count() == odd_docs.count()
    want = sorted(len(SPACE.findall(r.text or "")) for r in odd_docs.collect())
    assert sorted(r.n_tokens for r in mixed.collect()) == want
    assert mixing.keep(odd_docs).columns == odd_docs.columns
    assert mixing.mix(no_docs).count() == 0


# --- pipeline


def test_pipeline_keeps_columns_and_its_promises(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, docs, sf).cache()
        assert kept.columns == docs.columns
        assert 0 < kept.count() <= docs.count(), name
        assert kept.join(docs, docs.columns, "left_anti").count() == 0
        docs = kept
    benchmark = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = docs.collect()
    assert not any(brute_hits(r.text, benchmark)[1] for r in rows[:20])
    assert all(len(SPACE.findall(r.text)) >= 10 for r in rows)


def test_pipeline_takes_odd_documents(spark, sf, odd_docs, no_docs):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd_docs, sf).columns == odd_docs.columns, name
        assert stage(spark, no_docs, sf).count() == 0, name


def test_each_stage_equals_a_plain_version(spark, sf, tmp_path):
    import duckdb

    def fails(text):
        """The rules every policy has: few words, or too many of them in repeated windows."""
        words = SPACE.findall(text or "")
        places = collections.defaultdict(list)
        for i in range(len(words) - 4):
            places[tuple(words[i : i + 5])].append(i)
        repeated = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(5)}
        return len(words) < 10 or 100 * len(repeated) > 20 * len(words)

    def rows(df):
        return sorted((tuple(r) for r in df.collect()), key=repr)

    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality_rules"](spark, docs, sf).cache()
    failed = {r.doc_id for r in docs.collect() if fails(r.text)}
    assert not failed & {r.doc_id for r in kept.collect()} and len(failed) > 0

    scored = toxicity.score(kept, toxicity.fit(kept, toxicity.training_labels(spark.read.parquet(f"{sf}/labels.parquet"))))
    clean = {r.doc_id for r in scored.collect() if r.score < r.threshold}
    after = stages["toxicity"](spark, kept, sf).cache()
    assert rows(after) == [r for r in rows(kept) if r[0] in clean]

    found = brute_components([(r.doc_id, r.text) for r in after.collect()], percent=80)
    single = stages["near_dedup"](spark, after, sf).cache()
    assert rows(single) == [r for r in rows(after) if found[r[0]][1] == r[0]]

    benchmark = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    sound = stages["decontamination"](spark, single, sf).cache()
    assert rows(sound) == [r for r in rows(single) if not brute_hits(r[1], benchmark)[1]]

    sound.coalesce(1).write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents/*.parquet'")
    chosen = {r[0] for r in con.execute(f"select doc_id from ({mixing.ORACLE_SQL}) where kept").fetchall()}
    assert rows(stages["mixing"](spark, sound, sf)) == [r for r in rows(sound) if r[0] in chosen]


def test_raking_by_joins_equals_raking_by_windows(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: (r.weight, r.p) for r in mixing.query(spark, sf).collect()}
    monkeypatch.setattr(mixing, "WINDOWED", 0)
    got = {r.doc_id: (r.weight, r.p) for r in mixing.query(spark, sf).collect()}
    assert got.keys() == want.keys() and all(abs(a - b) < 2e-6 for k in got for a, b in zip(got[k], want[k]))
    cells = mixing.save(mixing.described(docs).groupBy(*mixing.DIMS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    given = mixing.shares({dim: mixing.tempered(cells, dim) for dim in mixing.DIMS})
    ends = [max(mixing.residuals(mixing.rake(cells, given, rounds=n), given).values()) for n in (1, 4)]
    assert ends[1] <= ends[0]
