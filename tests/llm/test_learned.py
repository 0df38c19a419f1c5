"""Held-out accuracy of what is learned, gradients, and the cases without anything to learn from."""

import collections
import math
import pickle
import random
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloakwork.llm import language as L
from cloakwork.llm import toxicity as T

SF = "/root/testdata/sf0.1"


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    net = L.new_network(["a", "b", "c"], 5, 11, rng)
    double = [w.astype(float) for w in net.arrays()]
    net = L.Network(net.languages, L.Direction(*double[:2]), L.Direction(*double[2:4]), double[4], double[5], 11)
    x, y = rng.integers(0, 256, (7, 11)).astype(np.uint8), rng.integers(0, 3, 7)
    counts = np.ones((7, 11))
    counts[2, 6:] = 0
    _, grads = L.loss_and_gradients(net, x, y, counts)
    for w, g in zip(net.arrays(), grads):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        was, step = w[at], 1e-2
        w[at] = was + step
        up, _ = L.loss_and_gradients(net, x, y, counts)
        w[at] = was - step
        down, _ = L.loss_and_gradients(net, x, y, counts)
        w[at] = was
        assert abs((up - down) / (2 * step) - g[at]) < 1e-3 * max(1, abs(g[at]))


def test_pooled_agrees_with_the_network_that_is_trained():
    rng = np.random.default_rng(1)
    net = L.new_network(["a", "b"], 6, 20, rng)
    x = rng.integers(0, 256, (9, 20)).astype(np.uint8)
    counts = rng.random((9, 20)) < 0.7
    ahead, _ = L._read(net.ahead, x, list(range(20)))
    back, _ = L._read(net.back, x, list(range(20))[::-1])
    logits = np.concatenate([ahead, back], axis=2) @ net.out + net.bias
    p = np.exp(logits) / np.exp(logits).sum(axis=2, keepdims=True)
    sums, labelled = L.pooled(net, x, counts)
    assert np.abs(sums - (p * counts.T[:, :, None]).sum(axis=0)).max() < 1e-4
    assert (labelled.sum(axis=1) == counts.sum(axis=1)).all()


def test_windows_count_every_position_once():
    for n in (1, 95, 96, 97, 192, 500):
        starts = L.window_starts(n, 96)
        assert starts[-1] + 96 >= n and all(b - a <= 96 for a, b in zip(starts, starts[1:]))
        assert n < 96 or starts[-1] + 96 == n


def test_language_without_labels_or_letters(llm):
    schema = "doc_id long, text string, lang string, score string"
    df = llm.createDataFrame([(None, None, None, "x"), (1, "", "en", "x"), (1, "12 !?", "en", "x")], schema)
    assert L.fit(df.where("lang IS NULL")) is None and L.fit(df.limit(0)) is None
    got = L.predict(df, None).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)] * 3
    assert L.predict(df, None).columns == ["doc_id", "text", "lang", "lang_pred", "score", "label_share"]
    net = L.new_network(["x", "y"], 4, 96, np.random.default_rng(0))
    texts = [None, "12", "a", "ä" * 100_000]
    got = list(L.predictions(net, texts))
    assert [g[0] for g in got[:2]] == ["und", "und"] and all(0 < g[1] <= 1 for g in got[2:])


def test_language_held_out(llm):
    from cloakwork.llm import queries

    path = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in llm.read.parquet(f"{path}/documents.parquet").collect()}
    got = queries.op2_language_id(llm, path).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_toxicity_without_examples(llm):
    schema = "doc_id long, text string, score string"
    docs = llm.createDataFrame([(None, None, "x"), (1, "", "x"), (1, "a b", "x"), (2, "a " * 100_000, "x")], schema)
    labels = llm.createDataFrame([(1, 0), (1, None), (None, 1), (2, 7)], "doc_id long, toxic int")
    for given in (labels, labels.limit(0)):
        scorer = T.fit(docs, given)
        assert [(r.score, r.predicted) for r in T.score(docs, scorer).collect()] == [(0.0, 0)] * 4
    only = T.fit(docs, llm.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    assert [r.predicted for r in T.score(docs, only).collect()] == [1] * 4
    assert T.score(docs.limit(0), only).count() == 0


def plain_ratio(rows, letters, word):
    """Log-ratio of a word from (label, text) rows: counts of contexts in each fold, discounts and backoff written out."""
    seen = {
        (y, T.fold_of(t), u, v, w)
        for y, t in rows
        for own in [T.words(t)]
        for u, v, w in zip(["", "", *own], ["", *own], own)
    }
    count = collections.Counter()
    for y, _, _, _, w in seen:
        spelled = w[: T.LONGEST] + T.END
        for n in range(len(spelled) + 1):
            count[y, spelled[:n]] += 1
    for w in {w for *_, w in seen}:
        spelled = w[: T.LONGEST] + T.END
        for n in range(len(spelled) + 1):
            count["t", spelled[:n]] += 1
    every = {b for _, b in count}

    def off(kind, n):
        of = collections.Counter(c for (k, b), c in count.items() if k == kind and b)
        one, two = max(1, of[1]), max(1, of[2])
        y = one / (one + 2 * two)
        n = min(n, 3)
        return min(max(n - (n + 1) * y * max(1, of[n + 1]) / max(1, of[n]), 0.05), n - 0.05) if n else 0.0

    kept = {b for b in every if count[0, b] + count[1, b] >= T.LEAST or not b}

    def rest(kind, b):
        return max(count[kind, b] - off(kind, count[kind, b]), 0) if b in kept else 0

    def free(kind, b):
        n = count[kind, b]
        return max((n - sum(rest(kind, c) for c in every if c and c[:-1] == b)) / n, 1e-9) if n else 1.0

    spelled, total = word[: T.LONGEST] + T.END, 0.0
    for n in range(1, len(spelled) + 1):
        b, before = spelled[:n], spelled[: n - 1]
        if b not in kept:
            return total + math.log(free(1, before) / free(0, before))
        shared = rest("t", b) / max(1, count["t", before]) + free("t", before) / letters
        p = [rest(y, b) / max(1, count[y, before]) + free(y, before) * shared for y in (0, 1)]
        total += math.log(p[1] / p[0])
    return total


def test_models_against_counts_in_plain_python(llm):
    rng = random.Random(4)
    words = ["idiot", "idiotic", "idle", "tree", "trees", "a", "é", "x" * 30, "x" * 16 + "y"]
    rows = [(y, " ".join(rng.choices(words, [3 * y, y, 1, 2, 1, 3, 1, 1, 1], k=rng.randint(1, 9)))) for y in (0, 1) * 12]
    rows += [(1, None), (0, ""), rows[0], rows[0], rows[1]]
    folds = [T.fold_of(t) for _, t in rows]
    sample = llm.createDataFrame([(y, t, k) for (y, t), k in zip(rows, folds)], "label int, text string, fold int").repartition(3)
    models = T._models(sample, T.RHO)
    letters = len({c for _, t in rows for w in T.words(t) for c in w[: T.LONGEST]} | {T.END})
    for fold, model in enumerate(models):
        own = [r for r, k in zip(rows, folds) if k != fold]
        for word in [*words, "idiocy", "trie", "zz", "x", "x" * 17]:
            assert abs(model.ratio(word) - plain_ratio(own, letters, word)) < 1e-4, (fold, word)
    assert models[-1].ratio("idiots") > 0 > models[-1].ratio("trees")
    text = "idiot zz tree"
    each = [math.log(1 + T.RHO * (math.exp(models[-1].ratio(w)) - 1)) for w in text.split()]
    assert abs(models[-1].difference(text) - sum(each) / (3 + T.LENGTH_PRIOR)) < 1e-12


def test_the_driver_holds_little_for_each_beginning(llm):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 10))) for _ in range(10_000)]
    rows = [(k % 2, " ".join(rng.choices(words, k=150)), k % T.FOLDS) for k in range(300)]
    sample = llm.createDataFrame(rows, "label int, text string, fold int").repartition(3)
    tracemalloc.start()
    try:
        models = T._models(sample, T.RHO)
        _, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    n = len(models[0].numbers)
    assert n > 20_000 and peak < 350 * n, peak / n
    small = models[-1].compact()
    packed = pickle.loads(pickle.dumps([*models, small]))
    assert type(packed[0].numbers) is dict and all(m.numbers is packed[0].numbers for m in packed[:-1])
    for one, other in zip([*models, small], packed):
        assert list(one.numbers.items()) == list(other.numbers.items())
        assert all(one.ratio(w) == other.ratio(w) for w in words[:200])


def test_a_compact_model_gives_the_same_evidence():
    rng = random.Random(3)
    numbers = {"": 0}
    for _ in range(300):
        word = "".join(rng.choices("abc", k=rng.randint(1, 6))) + T.END
        for n in range(1, len(word) + 1):
            numbers.setdefault(word[:n], 0)
    names = sorted(numbers, key=lambda b: (len(b), b))
    numbers = {b: i for i, b in enumerate(names)}
    upto, leaving = (np.array([rng.gauss(0, 3) for _ in names], np.float32) for _ in range(2))
    model = T.Model(numbers, upto, leaving)
    small = model.compact(0.05)
    assert 10 < len(small.numbers) < len(numbers)
    for _ in range(500):
        word = "".join(rng.choices("abcd", k=rng.randint(1, 8)))
        assert abs(model.value(word) - small.value(word)) < 0.05


def test_discounts_are_modified_kneser_ney():
    y = 100 / (100 + 2 * 40)
    assert np.allclose(T.discounts([100, 40, 20, 10]), [0, 1 - 2 * y * 0.4, 2 - 3 * y * 0.5, 3 - 4 * y * 0.5])
    assert (T.discounts([0, 0, 0, 0]) < [0.1, 1, 2, 3]).all()


@pytest.mark.parametrize("case", range(20))
def test_cut_by_trying_all(case):
    rng = np.random.default_rng(case)
    x, y = rng.integers(0, 6, 30) / 5, rng.integers(0, 2, 30)
    weight = rng.random(30)
    cut, wrong = T.least_wrong_cut(x, y, weight)
    tried = [weight[(x >= t) != (y == 1)].sum() for t in np.arange(-0.1, 1.3, 0.2)]
    assert abs(wrong - min(tried)) < 1e-9
    assert abs(weight[(x >= cut) != (y == 1)].sum() - wrong) < 1e-9


def test_toxicity_held_out(llm):
    """Against the labels of rows that were kept out, for each language."""
    from cloakwork.llm import queries

    docs = llm.read.parquet(f"{SF}/documents.parquet")
    got = queries.op5_toxicity(llm, SF).collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    truth = {r.doc_id: r for r in llm.read.parquet(f"{SF}/labels.parquet").join(docs, "doc_id").collect()}
    held = [(truth[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in truth]
    for lang in ("en", "de", "fr", "es"):
        assert np.mean([p for t, p in held if t.toxic == 1 and t.lang == lang]) >= 0.85
        assert np.mean([p for t, p in held if t.toxic == 0 and t.lang == lang]) <= 0.03


def test_toxicity_cut_holds_for_small_samples(llm):
    docs = llm.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = llm.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    aside = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    for sample in (200, 400, 1500):
        scorer = T.fit(docs, labels.where(~aside), sample=sample)
        rows = T.score(docs.join(labels, "doc_id").where(aside), scorer).collect()
        assert np.mean([r.predicted for r in rows if r.toxic == 1]) >= 0.88
        assert np.mean([r.predicted for r in rows if r.toxic == 0]) <= 0.09
