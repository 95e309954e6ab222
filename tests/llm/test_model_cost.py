"""The language model does no work twice, and what it saves changes no score."""

import numpy as np
from pyspark import cloudpickle

from quarry.llm import language_model as lm


def vocabulary(n=3000):
    dice = np.random.default_rng(1)
    names = np.unique(dice.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
    names[: n // 4] = (names[: n // 4] & np.uint64((1 << 44) - 1)) | np.uint64(5 << 44)  # many of the same leading bits
    names = np.unique(np.r_[names, np.uint64(lm.END)])
    counts = dice.integers(1, 900, len(names))
    return lm.Vocabulary(names, counts, int(counts[names == lm.END][0]), [(k, 50_000, 500) for k in range(lm.CLASSES)])


def test_names_are_looked_up_as_by_search():
    vocab, dice = vocabulary(), np.random.default_rng(2)
    asked = np.r_[vocab.names, vocab.names + np.uint64(1), dice.integers(0, 1 << 63, 2000).astype(np.uint64), np.uint64(0), np.uint64((1 << 64) - 1)]
    found, symbols = vocab.look_up(asked)
    known = {int(n): i for i, n in enumerate(vocab.names)}
    assert found.tolist() == [known.get(int(n), -1) for n in asked]
    told = [vocab.symbol[known[int(n)]] if int(n) in known else vocab.class_symbol[int(n) & 127] for n in asked]
    assert symbols.tolist() == told


def test_equal_contexts_are_scored_once_and_rightly(monkeypatch):
    vocab, dice = vocabulary(), np.random.default_rng(3)
    model, size = lm.Bilinear(vocab.prior), len(vocab.prior)
    far, near, word = np.repeat(dice.integers(0, 40, 700), 5), np.repeat(dice.integers(0, 40, 700), 5), dice.integers(0, size, 3500)
    asked, plain = [], model._normalised
    monkeypatch.setattr(model, "_normalised", lambda *a: asked.append((a[4], len(a[0]))) or plain(*a))
    for scale in (1, 400):  # the second beyond what exponentials can be summed of as they are
        model.near, asked[:] = model.near * np.float32(scale), []
        got = model.log_probabilities(far, near, word)
        assert sum(n for level, n in asked if level == 0) == len(set(zip(far.tolist(), near.tolist(), strict=True)))
        hidden, want = (model.near[near] + model.far[far]).astype(float), np.zeros(len(word))
        for i in range(0, len(word), 7):
            g = model.group[word[i]]
            for out, bias, at in ((model.out[0], model.bias[0], g), (model.out[1][model.edges[g] : model.edges[g + 1]], model.bias[1][model.edges[g] : model.edges[g + 1]], word[i] - model.edges[g])):
                s = out.astype(float) @ hidden[i] + bias
                want[i] += s[at] - s.max() - np.log(np.exp(s - s.max()).sum())
            assert abs(got[i] - want[i]) < 1e-3 * max(1, abs(want[i]))


def test_a_worker_keeps_its_names():
    def nested():
        return lm.kept_words()

    assert cloudpickle.loads(cloudpickle.dumps(nested))() is lm.kept_words()
