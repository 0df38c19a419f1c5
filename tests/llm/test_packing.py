import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from cloakwork.llm import packing

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN


def test_cut():
    assert packing.cut(5, 8) == [(0, 5)]
    assert packing.cut(8, 8) == [(0, 8)]
    assert packing.cut(17, 8) == [(0, 1), (1, 8), (9, 8)]
    assert packing.cut(16, 8) == [(0, 8), (8, 8)]


def test_knapsack_is_the_best_by_brute_force():
    rng = random.Random(3)
    for _ in range(30):
        capacity = rng.randint(3, 12)
        prices = np.full(capacity + 1, -np.inf)
        for n in rng.sample(range(1, capacity + 1), rng.randint(1, capacity)):
            prices[n] = rng.random()
        best = [0.0] * (capacity + 1)
        for room in range(1, capacity + 1):
            best[room] = max([best[room - 1], *(best[room - n] + prices[n] for n in range(1, room + 1) if prices[n] > -np.inf)])
        got = packing.priciest(prices, capacity)
        assert sum(n * c for n, c in got.items()) <= capacity
        assert abs(sum(prices[n] * c for n, c in got.items()) - best[capacity]) < 1e-9


@pytest.mark.parametrize("seed", range(6))
def test_configurations_hold_exactly_the_histogram(seed):
    rng = random.Random(seed)
    histogram = {n: rng.randint(1, 400) for n in rng.sample(range(1, 65), rng.randint(1, 40))}
    configs = packing.configurations(histogram, 64)
    held = collections.Counter()
    for config, copies in configs:
        assert sum(n * count for n, count in config) <= 64
        for n, count in config:
            held[n] += copies * count
    assert held == histogram
    used = sum(c for _, c in configs)
    descending = packing.best_fit([n for n, c in histogram.items() for _ in range(c)], 64)
    assert used <= 1.005 * len(descending) + 1


def test_full_sequences_where_lengths_are_many():
    rng = random.Random(1)
    histogram = collections.Counter(min(256, int(rng.lognormvariate(4, 1)) + 1) for _ in range(20_000))
    used = sum(c for _, c in packing.configurations(histogram, 256))
    assert used <= 1.002 * sum(n * c for n, c in histogram.items()) / 256 + 1


def test_places_are_gapless_for_repeated_null_and_empty(llm):
    rows = [(None, None), (1, ""), (1, ""), (2, "word " * 5000), (2, "word " * 5000), (3, "a b")]
    df = llm.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, length long")
    got = packing.pack(df, VOCABULARY, PATTERN).collect()
    by_sequence = collections.defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    ids = np.append(packing.token_ids(VOCABULARY, PATTERN, "word " * 5000), 0).astype("<u4")
    pieces = collections.Counter((r.piece, r.start, r.length, r.ids_crc32) for r in got if r.doc_id == 2)
    want = [(k, s, n, zlib.crc32(ids[s : s + n])) for k, (s, n) in enumerate(packing.cut(len(ids), 2048))]
    assert pieces == collections.Counter(want * 2)
    assert sorted(r.length for r in got if r.doc_id in (None, 1)) == [1, 1, 1]
    assert packing.pack(df.limit(0), VOCABULARY, PATTERN).count() == 0


def test_query_packs_every_token_once(llm):
    from tokenizers import Tokenizer

    from cloakwork.llm import queries

    library = Tokenizer.from_file(VOCABULARY)
    docs = {r.doc_id: r.text for r in llm.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = collections.defaultdict(list)
    for r in queries.op8_best_fit_packing(llm, "/root/testdata/sf0.001").collect():
        got[r.doc_id].append(r)
    total = 0
    for doc_id, text in docs.items():
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        want = [(k, s, n, zlib.crc32(ids[s : s + n])) for k, (s, n) in enumerate(packing.cut(len(ids), 2048))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in got[doc_id]) == want
    sequences = len({r.sequence_id for rows in got.values() for r in rows})
    assert sequences <= 1.03 * -(-total // 2048) + 1
