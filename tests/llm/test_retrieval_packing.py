import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cloakwork.llm import packing, queries
from cloakwork.llm import retrieval_packing as R

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string, n long, shard string, ids string"
TOPICS = ["ship sail harbour anchor mast tide", "bread flour oven yeast crust dough", "planet orbit comet moon star dust"]


def ids_of(text):
    return [*packing.token_ids(VOCABULARY, PATTERN, text or "").tolist(), R.END_ID]


def made(n, seed=3):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        words = rng.choice(TOPICS).split() * 3 + ["and", "the"]
        rows.append((rng.choice([None, k]), " ".join(rng.choices(words, k=rng.choice([1, 8, 30, 120])))))
    return rows + [(n, None), (n + 1, "")] + rows[:4] * 4 + [(n + 2, "anchor " * 900)]


def plain_pieces(texts, capacity):
    """Windows of (place of the document in texts, start, length): every unused document scored for each look-up."""
    docs = [ids_of(t)[:-1] for t in texts]
    holding = collections.Counter(t for d in docs for t in set(d))
    mean = max(1.0, sum(map(len, docs)) / max(1, len(docs)))

    def weights(d):
        out = {}
        for t, tf in collections.Counter(d).items():
            idf = float(np.log1p((len(docs) - holding[t] + 0.5) / (holding[t] + 0.5)))
            out[t] = int(R.SCALE * idf * (tf * (R.K1 + 1) / (tf + R.K1 * (1 - R.B + R.B * len(d) / mean))))
        return out

    held = [weights(d) for d in docs]
    key = [min(w, key=lambda t: (-w[t], t)) if w else -1 for w in held]
    order = sorted(range(len(docs)), key=lambda k: (key[k], k))
    unused, windows, cut = list(order), [], None
    while unused or cut:
        if cut is None:
            cut = (unused.pop(0), 0)
        seed, start = cut
        take = min(capacity, len(docs[seed]) + 1 - start)
        window, room = [(seed, start, take)], capacity - take
        cut = (seed, start + take) if start + take <= len(docs[seed]) else None
        asked = sorted(held[seed], key=lambda t: (-held[seed][t], t))[: R.QUERY_TERMS]
        while room and unused:
            scores = {d: sum(held[d].get(t, 0) for t in asked) for d in unused}
            near = sorted((d for d in unused if scores[d] > 0), key=lambda d: (-scores[d], order.index(d)))[: R.NEIGHBOURS]
            near = near or unused[:1]
            for d in list(near):
                if len(docs[d]) + 1 <= room:
                    window.append((d, 0, len(docs[d]) + 1))
                    room -= len(docs[d]) + 1
                    near.remove(d)
                    unused.remove(d)
            if room and near:
                window.append((near[0], 0, room))
                cut, room = (near[0], room), 0
                unused.remove(near[0])
        windows.append(window)
    last = sum(n for _, _, n in windows[-1]) if windows else capacity
    if last < capacity:
        flat = [(d, s + k) for d, s, n in windows.pop() for k in range(n)]
        for bit in reversed(range(last.bit_length())):
            if last >> bit & 1:
                part, flat = flat[: 1 << bit], flat[1 << bit :]
                runs = []
                for d, at in part:
                    if runs and runs[-1][0] == d and runs[-1][1] + runs[-1][2] == at:
                        runs[-1][2] += 1
                    else:
                        runs.append([d, at, 1])
                windows.append([tuple(r) for r in runs])
    return windows


def check(rows, ids, capacity, padding=0):
    """`ids` are the documents' ids; every id is in one piece, sequences are gapless and full or powers of two."""
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]]
        total = sum(r.length for r in own)
        assert total == capacity or total < capacity and total & (total - 1) == 0
    assert sum(r.length for r in rows) == sum(map(len, ids))
    assert min(r.length for r in rows) > 0
    return sequences


@pytest.mark.parametrize("capacity", [16, 64, 2048])
def test_one_shard_is_the_plain_greedy_one(llm, capacity):
    texts = [t for _, t in made(50)]
    docs = llm.createDataFrame([(k, t, 1, "s", "x") for k, t in enumerate(texts)], SCHEMA).coalesce(1)
    got = R.pack(docs, VOCABULARY, PATTERN, capacity=capacity, shard_tokens=1 << 30).collect()
    ids = [ids_of(t) for t in texts]
    check(got, ids, capacity)
    windows = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        windows[r.sequence_id].append((r.doc_id, r.start, r.length))
        whole = np.array(ids[r.doc_id], "<u4")
        assert r.doc_tokens == len(whole) and r.ids_crc32 == zlib.crc32(whole[r.start : r.start + r.length])
    assert list(windows.values()) == plain_pieces(texts, capacity)


def test_odd_and_repeated_rows_over_many_shards(llm):
    rows = made(60)
    docs = llm.createDataFrame([(i, t, 1, "s", "x") for i, t in rows], SCHEMA).repartition(5)
    got = R.pack(docs, VOCABULARY, PATTERN, capacity=32, shard_tokens=300).collect()
    check(got, [ids_of(t) for _, t in rows], 32)
    assert len({r.sequence_id >> 32 for r in got}) > 5
    pieces = collections.Counter((r.doc_id, r.doc_tokens) for r in got for _ in range(r.length))
    expected = collections.Counter()
    for i, t in rows:
        expected[(i, len(ids_of(t)))] += len(ids_of(t))
    assert pieces == expected


def test_empty_table(llm):
    assert R.pack(llm.createDataFrame([], SCHEMA), VOCABULARY, PATTERN).collect() == []


def test_shards_hold_hot_keys_in_parts_and_small_ones_together():
    plan = R.shard_plan({7: 10, 1: 30, 2: 30, 3: 50, 5: 950, 9: 40}, 100)
    assert plan == {1: (0, 1), 2: (0, 1), 3: (1, 1), 5: (2, 10), 7: (12, 1), 9: (12, 1)}
    assert R.shard_plan({}, 100) == {}


def test_powers_of_two():
    runs = R.powers([(0, 5, 9), (1, 0, 4)])
    assert runs == [[(0, 5, 8)], [(0, 13, 1), (1, 0, 3)], [(1, 3, 1)]]


def test_neighbours_share_a_window_more_often_than_by_chance(llm):
    rng = random.Random(1)
    topic = [k % 3 for k in range(240)]
    texts = [" ".join(rng.choices(TOPICS[t].split() + ["and", "the", "of"], k=20)) for t in topic]
    docs = llm.createDataFrame([(k, t, 1, "s", "x") for k, t in enumerate(texts)], SCHEMA).repartition(3)
    got = R.pack(docs, VOCABULARY, PATTERN, capacity=128).collect()
    sequences = collections.defaultdict(set)
    for r in got:
        sequences[r.sequence_id].add(r.doc_id)
    pairs = [topic[a] == topic[b] for s in sequences.values() for a in s for b in s if a < b]
    assert np.mean(pairs) > 0.9


def test_runs_are_the_patterns_matches(llm):
    rng = random.Random(8)
    texts = ["".join(rng.choices("aZé1٣ \n\t\u00a0\u3000'’sStmdrelv.!-日", k=rng.randint(0, 30))) for _ in range(20_000)]
    texts += [r.text for r in llm.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    for t in texts:
        fast, given = (packing.token_ids(VOCABULARY, p, t) for p in (queries.RUNS, PATTERN))
        assert np.array_equal(fast, given), t


def test_query_on_the_given_table(llm):
    sf = "/root/testdata/sf0.001"
    rows = llm.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    out = queries.op13_retrieval_packing(llm, sf)
    assert [f.dataType.simpleString() for f in out.schema.fields] == ["bigint"] * 7
    got = out.collect()
    check(got, [ids_of(r.text) for r in rows], 2048)
    ids = {r.doc_id: np.array(ids_of(r.text), "<u4") for r in rows}
    seen = collections.defaultdict(list)
    for r in got:
        whole = ids[r.doc_id]
        assert r.ids_crc32 == zlib.crc32(whole[r.start : r.start + r.length]) and r.doc_tokens == len(whole)
        seen[r.doc_id].append((r.start, r.length))
    for i, parts in seen.items():
        parts.sort()
        assert [s for s, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1]] and sum(n for _, n in parts) == len(ids[i])
    assert set(seen) == set(ids)
    assert out.where(F.col("length") <= 0).isEmpty()
