import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from cloakwork.llm import lexical_search, queries

DOCS = "doc_id long, text string, item_id long, score string, n long"
ITEMS = "item_id long, text string, doc_id string, rank int"
WORDS = ["Ab", "ab", "cd", "éé", "É", "x1", "the", "of", "zz", "日本", "ſ", "q-r", "k"]


def plain_terms(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def plain_search(docs, items, k=20):
    """(item id, rank, doc id, score) of rows of id and text."""
    held = [(i, collections.Counter(plain_terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in held]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = collections.Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        asked = collections.Counter(plain_terms(text))
        found = []
        for (i, c), size in zip(held, sizes):
            score = sum(
                times * lexical_search.weight(n, df[t]) * (10**9 * c[t] // (1000 * c[t] + 12 * (75 + 25 * size * n // total)))
                for t, times in asked.items()
                if t in c
            )
            if score > 0:
                found.append((-score, i is None, i))
        found.sort(key=lambda f: (f[0], f[1], f[2] or 0))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(found[:k], 1)]
    return sorted(out, key=repr)


def made(n, seed, longest=40):
    rng = random.Random(seed)
    rows = [(rng.choice([None, *range(n)]), " ".join(rng.choices(WORDS, range(len(WORDS), 0, -1), k=rng.randint(0, longest)))) for _ in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, "?! --")] + rows[:5] * 3


def test_terms_are_the_contracts():
    text = "A-b_C1 ÄÖ ſK [x]{y}\x00z\x7f日本 İI"
    assert [t.decode() for t in lexical_search.terms(text.encode())] == plain_terms(text)
    assert lexical_search.terms(None) == lexical_search.terms(b"") == []


@pytest.mark.parametrize("most_terms", [100_000, 3])
def test_search_against_all_documents(llm, most_terms):
    docs, items = made(120, 1), made(12, 2, 8)
    got = lexical_search.search(
        llm.createDataFrame([(*r, 5, "s", 1) for r in docs], DOCS).repartition(5),
        llm.createDataFrame([(*r, "d", 3) for r in items], ITEMS),
        k=7,
        most_terms=most_terms,
    )
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_search(docs, items, 7)


def test_empty_tables(llm):
    docs, items = llm.createDataFrame([(1, "a b", 1, "s", 1)], DOCS), llm.createDataFrame([(1, "a", "d", 1)], ITEMS)
    assert lexical_search.search(docs.limit(0), items).collect() == []
    assert lexical_search.search(docs, items.limit(0)).collect() == []
    assert lexical_search.search(docs.selectExpr("doc_id", "cast(null as string) text"), items).collect() == []


def blocks_of(rows, vocabulary, documents, all_terms):
    counts = [collections.Counter(vocabulary[t] for t in plain_terms(text) if t in vocabulary) for _, text in rows]
    offsets = np.cumsum([0, *map(len, counts)]).astype(np.int32)
    lists = [
        pa.ListArray.from_arrays(pa.array(offsets), pa.array([x for c in counts for x in getattr(c, part)()], pa.int32()))
        for part in ("keys", "values")
    ]
    ids, ns = [i for i, _ in rows], [len(plain_terms(text)) for _, text in rows]
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])
    return lexical_search._blocks(iter([batch.slice(0, 7), batch.slice(7)]), documents, all_terms)


@pytest.mark.parametrize("size", [1, 10, 1000])
def test_blocks_of_any_size_give_the_best(monkeypatch, size):
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", size)
    monkeypatch.setattr(lexical_search, "BLOCK_POSTINGS", 5 * size)
    monkeypatch.setattr(lexical_search, "SCORED_AT_ONCE", 3)
    docs = [(i, text) for i, (_, text) in enumerate(made(90, 4))]
    n, total = sum(bool(plain_terms(t)) for _, t in docs), sum(len(plain_terms(t)) for _, t in docs)
    df = collections.Counter(t for _, text in docs for t in set(plain_terms(text)))
    vocabulary = {t: k for k, t in enumerate(df)}
    item = [(0, "ab the 日本 ab k zz")]
    asked = collections.Counter(plain_terms(item[0][1]))
    held = [(vocabulary[t], times * lexical_search.weight(n, df[t])) for t, times in asked.items()]
    best = lexical_search.Best(5)
    for block, ids in blocks_of(docs, vocabulary, n, total):
        lexical_search.search_block(block, ids, held, best)
    assert [(0, rank, i, s) for rank, (s, i) in enumerate(best.rows, 1)] == plain_search(docs, item, 5)


def test_masks_of_more_than_a_word_and_a_safe_end():
    """80 terms: masks that differ in the last bits only are groups of their own, and weak ones stay unscored."""
    rng = random.Random(9)
    words = [f"w{k}" for k in range(80)]
    docs = [(i, " ".join(words[:70] + rng.sample(words[70:], rng.randint(1, 4)))) for i in range(40)]
    docs += [(100 + i, words[i % 80]) for i in range(400)]
    n, total = len(docs), sum(len(t.split()) for _, t in docs)
    df = collections.Counter(t for _, text in docs for t in set(text.split()))
    vocabulary = {t: k for k, t in enumerate(words)}
    ((block, ids),) = blocks_of(docs, vocabulary, n, total)
    held = [(vocabulary[t], lexical_search.weight(n, df[t])) for t in words]
    groups = list(block.groups(held))
    assert [b for b, _ in groups] == sorted((b for b, _ in groups), reverse=True)
    assert sorted(p for _, places in groups for p in places) == list(range(440))
    for _, places in groups:
        assert len({frozenset(docs[p][1].split()) for p in places}) == 1
    assert len(groups) == len({frozenset(t.split()) for _, t in docs})
    best = lexical_search.Best(20)
    assert lexical_search.search_block(block, ids, held, best) < 200
    assert [(0, rank, i, s) for rank, (s, i) in enumerate(best.rows, 1)] == sorted(plain_search(docs, [(0, " ".join(words))]), key=lambda r: r[1])


def test_query_against_all_documents(llm):
    sf = "/root/testdata/sf0.001"
    docs = llm.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    items = llm.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()
    got = queries.op12_lexical_search(llm, sf).collect()
    assert sorted(map(tuple, got), key=repr) == plain_search(docs, items)
