"""Impact search, Lloyd clusters and the BPE automaton against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quarry.llm import bpe_automaton, impact_index, lloyd

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain_ranks(docs, items, k):
    tfs = [(i, Counter(TERM.findall(lower(t)))) for i, t in docs]
    tfs = [(i, tf) for i, tf in tfs if tf]
    n, total = len(tfs), sum(sum(tf.values()) for _, tf in tfs)
    df = Counter(t for _, tf in tfs for t in tf)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(TERM.findall(lower(text)))
    out = []
    for item, terms in asked.items():
        found = []
        for i, tf in tfs:
            m = 100 - 50 + (50 * sum(tf.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 20 * m)) for t in terms if t in tf)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


ITEMS = [(1, "the quick Brown fox, FOX"), (1, "word"), (2, None), (3, "!!"), (None, "mit license 漢字"), (4, "nowhere zzz"), (5, "a text another words")]


@pytest.mark.parametrize("k", [1, 2, 50])
def test_impact_search_ranks_as_a_plain_scorer(spark, odd_docs, no_docs, k, monkeypatch):
    items = spark.createDataFrame([(*i, 1) for i in ITEMS], "item_id long, text string, rank long")
    want = plain_ranks([(r.doc_id, r.text) for r in odd_docs.collect()], ITEMS, k)
    monkeypatch.setattr(impact_index, "BLOCK", 2)
    got = impact_index.search(impact_index.build(odd_docs), items, k).collect()
    assert sorted(map(tuple, got), key=repr) == want
    assert impact_index.search(impact_index.build(no_docs), items, k).count() == 0
    assert impact_index.search(impact_index.build(odd_docs), items.limit(0), k).count() == 0


def test_impact_search_over_many_shards_and_ties(spark):
    r = random.Random(3)
    docs = [(i, " ".join(r.choices("abcdefghij", weights=range(1, 11), k=r.randint(0, 9)))) for i in range(3000)]
    items = [(i, " ".join(r.choices("abcdefghij", k=4))) for i in range(5)]
    index = impact_index.build(spark.createDataFrame(docs, "doc_id long, text string").repartition(7))
    got = impact_index.search(index, spark.createDataFrame(items, "item_id long, text string"), 20).collect()
    assert sorted(map(tuple, got), key=repr) == plain_ranks(docs, items, 20)


def test_shards_are_cut_by_documents_and_words():
    shard = impact_index.Shard()
    for i, words in [(3, [b"b", b"a", b"b"]), (None, [b"a"]), (1, [b"b"])]:
        shard.add(i, words)
    rows = shard.rows(7, 3, 5).to_pylist()
    assert rows[0]["ids"] == [1, 3, None] and rows[0]["term"] == "" and [(r["term"], r["holders"]) for r in rows[1:]] == [("b", 2), ("a", 2)]
    slices = impact_index.spread(rows[1]["places"], rows[1]["slices"])
    m = [50 + (50 * n * 3) // 5 for n in (1, 3)]
    impacts = [sum((x >> p & 1) << b for b, x in enumerate(slices)) for p in range(3)]
    assert impacts == [10**9 // (1000 + 20 * m[0]), 2 * 10**9 // (2000 + 20 * m[1]), 0]


def test_carry_arithmetic_and_slice_descent():
    r = random.Random(5)
    for _ in range(200):
        width = r.randint(1, 70)
        numbers = [[r.choice([0, 1, r.getrandbits(r.randint(1, 20))]) for _ in range(width)] for _ in range(3)]
        sliced = [[sum((v >> b & 1) << p for p, v in enumerate(ns)) for b in range(20)] for ns in numbers]
        weight = r.randint(0, 20000)
        total = impact_index.add(impact_index.add(impact_index.times(sliced[0], weight), sliced[1]), sliced[2])
        want = [weight * a + b + c for a, b, c in zip(*numbers, strict=True)]
        k = r.randint(1, width)
        assert sorted(impact_index.top(total, k)) == sorted(sorted(((p, v) for p, v in enumerate(want) if v), key=lambda x: (-x[1], x[0]))[:k])


def plain_lloyd(rows, k, rounds, scale=64, components=4):
    kept = [(i, [math.floor(scale * c) for c in x]) for i, x in rows if x is not None and len(x) == components and all(c is not None and math.isfinite(c) for c in x)]
    means = [x for _, x in sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]

    def best(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, m, strict=True)), c) for c, m in enumerate(means))

    for _ in range(rounds):
        groups = {}
        for _, x in kept:
            groups.setdefault(best(x)[1], []).append(x)
        means = [[sum(c) // len(groups[i]) for c in zip(*groups[i], strict=True)] if i in groups else m for i, m in enumerate(means)]
    return sorted([(i, best(x)[1], best(x)[0]) for i, x in kept], key=repr), means


def lloyd_rows(n):
    r = random.Random(9)
    rows = [(i, [r.uniform(-3, 3) for _ in range(4)]) for i in range(n)]
    odd = [(n, None), (n + 1, [1.0]), (n + 2, [1.0, None, 2.0, 3.0]), (n + 3, [float("nan")] * 4), (n + 4, [float("inf"), 0.0, 0.0, 0.0]), (None, [0.5] * 4), (0, [0.5] * 4), (0, [0.5] * 4)]
    return rows + odd


@pytest.mark.parametrize("n", [0, 5, 300])
def test_lloyd_is_plain_lloyd(spark, n):
    rows = lloyd_rows(n)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, cluster int, id string").repartition(5)
    assigned, clusters = lloyd.cluster(df, components=4, k=6)
    want, means = plain_lloyd(rows, 6, 3)
    assert sorted(map(tuple, assigned.collect()), key=repr) == want
    assert [list(map(int, r.components)) for r in clusters.orderBy("cluster").collect()] == means
    assert lloyd.cluster(df.limit(0), components=4)[0].count() == 0


def test_lloyd_with_enormous_components(spark):
    rows = [(i, [3.0e38 * (-1) ** i, 1e30 * i, float(i), -0.001]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assigned, clusters = lloyd.cluster(df, components=4, k=3)
    want, means = plain_lloyd(rows, 3, 3)
    assert sorted(map(tuple, assigned.collect()), key=repr) == [(i, c, d if d < 2**63 else None) for i, c, d in want]
    assert [list(map(int, r.components)) for r in clusters.orderBy("cluster").collect()] == means


PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd_texts():
    r = random.Random(2)
    pool = "abcdefgehinorst'sd 019ABZ\t\n éÉßİıΣσςÀ̀é가ᅡ中文🙂‍\x1c\x85\xa0Ⅷ²½ǅﬁ\x00"
    for _ in range(3000):
        yield "".join(r.choice(pool) for _ in range(r.randint(0, 25)))
    for _ in range(3000):
        yield "".join(chr(r.choice([r.randint(0, 0xD7FF), r.randint(0, 0x24F), r.randint(0xE000, 0x10FFFF)])) for _ in range(r.randint(0, 6)))
    for special in ("<|endoftext|>", "<|startoftext|>x", "A<|EndOfText|>", "<|endoftext|><|endoftext|>é"):
        yield f"Some words {special} and more"
    yield "a" * 5000 + " " + "the " * 5000


def test_bpe_automaton_encodes_and_decodes_as_the_library(library):
    definition = open(PATH, encoding="utf-8").read()
    quick, slow = bpe_automaton.Codec(definition, bpe_automaton.prove(definition)), bpe_automaton.Codec(definition, None)
    for text in odd_texts():
        want = library.encode(text, add_special_tokens=False).ids
        assert quick.encode(text) == want, text[:50]
        assert slow.encode(text) == want, text[:50]
        assert quick.decode(want) == library.decode(want, skip_special_tokens=False)


def test_bpe_automaton_of_small_merge_lists():
    """Every string over two symbols against merging by rank, over random merge lists."""
    r = random.Random(4)
    for _ in range(60):
        tokens, merges = ["a", "b"], []
        while len(merges) < 8:
            pair = (r.choice(tokens), r.choice(tokens))
            if "".join(pair) not in tokens:
                merges.append(pair)
                tokens.append("".join(pair))
        ids = {t: i for i, t in enumerate(tokens)}
        automaton = bpe_automaton.compile_merges(ids, merges)
        for n in range(1, 9):
            for bits in range(2**n):
                word = ["ab"[bits >> i & 1] for i in range(n)]
                for u, v in merges:
                    i = 0
                    while i < len(word) - 1:
                        if (word[i], word[i + 1]) == (u, v):
                            word[i : i + 2] = [u + v]
                        i += 1
                state = 0
                for token in word:
                    assert automaton.reads(state, ids[token])
                    state = automaton.target[ids[token]]
        # Each string has one path alone.
        paths = {(0, ""): 1}
        for n in range(1, 8):
            found = Counter(s for (_, s), c in paths.items() for _ in range(c) if len(s) == n - 1)
            assert set(found.values()) <= {1}
            for (state, s), c in list(paths.items()):
                if len(s) <= 7:
                    for token, i in ids.items():
                        if len(s) + len(token) == n and automaton.reads(state, i):
                            paths[automaton.target[i], s + token] = paths.get((automaton.target[i], s + token), 0) + c


def test_merges_that_cannot_be_compiled_are_refused():
    with pytest.raises(ValueError):
        bpe_automaton.compile_merges({"a": 0, "b": 1, "abb": 2, "ab": 3}, [("ab", "b"), ("a", "b")])


def test_bpe_operators(spark, odd_docs, no_docs, library):
    encoded = bpe_automaton.encode(odd_docs, PATH)
    rows = [(r.doc_id, r.text or "") for r in odd_docs.collect()]
    ids = [(i, library.encode(t, add_special_tokens=False).ids) for i, t in rows]
    assert sorted(((r.doc_id, r.ids) for r in encoded.collect()), key=repr) == sorted(ids, key=repr)
    decoded = [(i, library.decode(x, skip_special_tokens=False)) for i, x in ids]
    assert sorted(map(tuple, bpe_automaton.decode(encoded, PATH).collect()), key=repr) == sorted(decoded, key=repr)
    want = [(i, len(x), hashlib.sha256(b"".join(t.to_bytes(4, "little") for t in x)).hexdigest(), hashlib.sha256(d.encode()).hexdigest()) for (i, x), (_, d) in zip(ids, decoded, strict=True)]
    assert sorted(map(tuple, bpe_automaton.digests(odd_docs, PATH).collect()), key=repr) == sorted(want, key=repr)
    assert bpe_automaton.encode(no_docs, PATH).count() == bpe_automaton.decode(encoded.limit(0), PATH).count() == 0
