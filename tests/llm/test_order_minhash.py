import collections
import random

import numpy as np
import pyarrow as pa

from cloakwork.llm import order_minhash as O

SCHEMA = "doc_id long, text string, kept string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_alignment_never_finds_fewer_edits_than_there_are():
    rng = random.Random(1)
    found = 0
    for _ in range(400):
        words = rng.choice((8, 50, 1000))
        a = [rng.randrange(words) for _ in range(rng.randint(12, 60))]
        b = list(a)
        for _ in range(rng.randint(0, len(a) // 5)):
            i = rng.randrange(len(b))
            b[i : i + rng.randint(0, 1)] = [rng.randrange(words) for _ in range(rng.randint(0, 1))]
        if not b:
            continue
        most = int(0.2 * max(len(a), len(b)))
        got = O.edits(np.array(a, np.uint32), np.array(b, np.uint32), most)
        assert got > most or got >= distance(a, b)
        found += got <= most
    assert found > 100


def test_alignment_is_exact_for_edits_that_stand_apart():
    rng = random.Random(2)
    for _ in range(100):
        a = [rng.randrange(10**6) for _ in range(200)]
        b, at = [], 0
        edits = 0
        for i, word in enumerate(a):
            if i - at > 12 and rng.random() < 0.1:
                at = i
                edits += 1
                b += rng.choice(([], [rng.randrange(10**6)], [rng.randrange(10**6), word]))
            else:
                b.append(word)
        x, y = np.array(a, np.uint32), np.array(b, np.uint32)
        # Words after an edit too near to the end for a shingle count as edited too.
        assert edits == distance(a, b) <= O.edits(x, y, 40) <= edits + 4 and O.similar(x, y)
    half = np.concatenate([x[:100], np.arange(100, dtype=np.uint32)])
    assert not O.similar(x, half)


def test_exact_alignment_is_the_edit_distance():
    rng = random.Random(3)
    for _ in range(300):
        words = rng.choice((2, 8, 1000))
        a = [rng.randrange(words) for _ in range(rng.randint(1, 40))]
        b = [w for w in a if rng.random() < 0.9] if rng.random() < 0.7 else [rng.randrange(words) for _ in range(rng.randint(1, 40))]
        x, y, most = np.array(a, np.uint32), np.array(b, np.uint32), rng.randint(0, 45)
        want = min(distance(a, b), most + 1)
        was, O.MASKED = O.MASKED, rng.choice((0, O.MASKED))
        got = O.distance(x, y, most)
        O.MASKED = was
        assert got == want


def test_words_in_common_bound_the_distance_and_long_texts_are_banded():
    rng = random.Random(6)
    for _ in range(200):
        a, b = ([rng.randrange(12) for _ in range(rng.randint(1, 30))] for _ in range(2))
        common = O.words_in_common(np.array(a, np.uint32), np.array(b, np.uint32))
        assert common == (collections.Counter(a) & collections.Counter(b)).total()
        assert max(len(a), len(b)) - common <= distance(a, b)
    a = np.array([rng.randrange(10**6) for _ in range(30_000)], np.uint32)
    b = np.delete(a, rng.sample(range(30_000), 300))
    b[rng.sample(range(len(b)), 200)] = 10**7
    assert O.distance(a, b, 6_000) == O.distance(b, a, 600) == 500 and O.distance(a, b, 499) == 500


def repeating(rng):
    """A text that repeats a passage between its own words, and one without the first of the repeats."""
    passage = [rng.randrange(10**6) for _ in range(30)]
    parts = [[rng.randrange(10**6) for _ in range(12)] for _ in range(8)]
    a = [w for part in parts for w in (*passage, *part)]
    return a, a[30:]


def test_copies_of_texts_that_repeat_passages_are_similar():
    rng = random.Random(4)
    for _ in range(20):
        a, b = repeating(rng)
        most = O.most_edits(len(a), len(b), O.THRESHOLD)
        assert distance(a, b) == 30 <= most
        x, y = np.array(a, np.uint32), np.array(b, np.uint32)
        one, two = set(O.labelled(x).tolist()), set(O.labelled(y).tolist())
        assert len(one & two) >= 0.8 * len(one | two)
        # The chain alone is one repeat off.
        assert O.edits(x, y, most) > most and O.similar(x, y) and O.similar(y, x)
        b = b[: len(b) // 2] + [rng.randrange(10**6) for _ in range(len(b) // 2)]
        assert distance(a, b) > most and not O.similar(x, np.array(b, np.uint32))


def test_copies_that_repeat_passages_come_together_in_small_and_large_buckets(llm):
    rng = random.Random(5)
    rows = []
    for k in range(3):
        a, b = repeating(rng)
        rows += [(10 * k, " ".join(f"w{i}" for i in a)), (10 * k + 1, " ".join(f"w{i}" for i in b))]
    df = llm.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    want = {i: i - i % 10 for i, _ in rows}
    assert {r.doc_id: r.class_id for r in O.near_duplicates(df).collect()} == want
    # Blocks of large buckets align their members where they are.
    a, b = repeating(rng)
    words = [np.array(w, "<u4").tobytes() for w in (a, b)]
    table = pa.table({
        "one": [0, 0], "two": [0, 0], "function": [0, 0], "node": [5, 6], "n": [len(a), len(b)], "component": [5, 6], "side": [0, 0],
        "lowest": [b"\x01" * 4 * O.SKETCHES] * 2, "sketch": [b"\x01" * 4 * O.SKETCHES] * 2, "words": words,
    })
    assert O._block_links(O.THRESHOLD)(table).to_pylist() == [{"a": 5, "b": 6}]


def test_kmers_are_unique_and_read_in_parts():
    words = ("a b c d e " * 300 + "f").encode()
    kmers = O.labelled(O.word_hashes(words))
    assert len(kmers) == 1501 - 4 and len(set(kmers.tolist())) == len(kmers)
    text = " ".join(f"w{i % 977}" for i in range(40_000)).encode()
    whole = O.word_hashes(text)
    was, O.BYTES_AT_ONCE = O.BYTES_AT_ONCE, 1000
    assert (O.word_hashes(text) == whole).all()
    O.BYTES_AT_ONCE = was
    kmers = O.labelled(whole)
    was, O.KMERS_AT_ONCE = O.KMERS_AT_ONCE, 97
    in_parts = O.sketches(kmers)
    O.KMERS_AT_ONCE = was
    assert all((a == b).all() for a, b in zip(in_parts, O.sketches(kmers)))


def test_odd_rows(llm):
    text = "one two three four five six seven eight nine ten"
    rows = [(9, text), (3, text.upper() + "!"), (3, text), (None, text), (None, None), (None, None), (4, ""), (5, ""), (6, "?!"), (7, "?!"), (8, "two words"), (2, "Two, words")]
    got = O.near_duplicates(llm.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()
    assert len(got) == len(rows)
    kept = collections.Counter((r.class_id, r.class_size) for r in got if r.kept)
    assert kept == {(3, 4): 1, (None, 1): 2, (4, 1): 1, (5, 1): 1, (6, 2): 1, (2, 2): 1}
    assert O.near_duplicates(llm.createDataFrame([], SCHEMA)).count() == 0


def test_large_groups_that_share_a_passage_stay_apart_and_copies_come_together(llm):
    rng = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = []
    for i in range(60):
        own = [f"x{rng.randrange(10**6)}" for _ in range(120)]
        rows.append((i, " ".join([*own[:60], passage, *own[60:]])))
    base = [f"b{rng.randrange(10**6)}" for _ in range(150)]
    for i in range(80):
        copy = list(base)
        for at in rng.sample(range(150), 5):
            copy[at] = f"e{rng.randrange(10**6)}"
        rows.append((100 + i, " ".join(copy)))
    rows.append((99, " ".join(base)))
    was, O.BLOCK = O.BLOCK, 20
    got = {r.doc_id: r for r in O.near_duplicates(llm.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()}
    O.BLOCK = was
    assert all(got[i].class_id == i and got[i].kept for i in range(60))
    assert all(got[i].class_id == 99 and got[i].class_size == 81 for i in range(99, 180))


def test_query_against_all_pairs(llm):
    from cloakwork.llm import queries

    path = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in llm.read.parquet(f"{path}/documents.parquet").collect()}
    words = {i: O.word_hashes(O.normal_form(t)) >> np.uint64(32) for i, t in docs.items()}
    holders = collections.defaultdict(list)
    for i, w in words.items():
        for kmer in O.labelled(O.word_hashes(O.normal_form(docs[i]))).tolist():
            holders[kmer].append(i)
    common = collections.Counter((a, b) for own in holders.values() for k, a in enumerate(own) for b in own[k + 1 :])
    group = {i: i for i in docs}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for (a, b), n in common.items():
        if n > 0.05 * max(len(words[a]), len(words[b])) and O.similar(words[a], words[b]):
            a, b = find(a), find(b)
            group[max(a, b)] = min(a, b)
    got = {r.doc_id: r for r in queries.op7_order_minhash(llm, path).collect()}
    assert len(got) == len(docs)
    wrong = [i for i in docs if got[i].class_id != find(i)]
    assert len(wrong) <= 0.002 * len(docs)
    assert sum(r.kept for r in got.values()) == len({r.class_id for r in got.values()})
