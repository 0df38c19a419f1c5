import collections

import corpus_pipeline as C
import pytest

from cloakwork.llm import language, order_minhash, secret_scan, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_are_the_operators(llm):
    docs = llm.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels = llm.read.parquet(f"{SF}/labels.parquet")

    scorer = toxicity.fit(docs, labels)
    first = C.STAGES[0][1](llm, docs, SF)
    rows = docs.collect()
    toxic = {r.doc_id for r, s in zip(rows, scorer.scores([r.text for r in rows])) if s >= 0.5}
    assert first.columns == columns
    assert {r.doc_id for r in first.collect()} == {r.doc_id for r in rows} - toxic

    second = C.STAGES[1][1](llm, first, SF)
    assert second.columns == columns
    assert {r.doc_id for r in second.collect()} == {r.doc_id for r in first.collect() if r.text and language.LETTER.search(r.text)}

    third = C.STAGES[2][1](llm, second, SF)
    classes = order_minhash.near_duplicates(second).collect()
    assert third.columns == columns
    assert {r.doc_id for r in third.collect()} == {r.doc_id for r in classes if r.kept}

    fourth = C.STAGES[3][1](llm, third, SF)
    assert fourth.columns == columns
    before = {r.doc_id: r.text for r in third.collect()}
    for r in fourth.collect():
        found = secret_scan.Scanner().scan(before[r.doc_id])
        assert (r.text == before[r.doc_id]) == (not found)
        if found:
            assert secret_scan.Scanner().scan(r.text) == [] and r.n_chars == len(r.text)

    last = C.STAGES[4][1](llm, fourth, SF).collect()
    pieces = collections.Counter(r.doc_id for r in last)
    assert set(pieces) == set(before)


@pytest.mark.parametrize("n", [6, 0])
def test_odd_rows_in_every_stage(llm, n):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, key string"
    rows = [(None,) * 7, (1, "", None, None, 0, 1.0, "k"), (1, "", None, None, 0, 1.0, "k")]
    rows += [(2, "a b c d e f g h", "en", "x", 9, 1.0, "k")] * 2 + [(3, "!!", "en", "x", 9, 1.0, "k")]
    docs = llm.createDataFrame(rows[:n], schema)
    kept = []
    for _, stage in C.STAGES:
        out = stage(llm, docs, SF)
        got = out.collect()
        kept.append(len(got))
        docs = llm.createDataFrame(got, out.schema)
    assert kept == ([6, 2, 1, 1, 1] if n else [0] * 5)


def test_run(llm):
    got = C.run(llm, SF).collect()
    by_sequence = collections.defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048


def test_documents_stay_where_no_language_is_named(llm):
    rows = [(1, "a b c", None, "s", 5), (2, "12 !", None, "s", 4), (3, None, None, None, None), (4, "日本", None, "s", 2)]
    docs = llm.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in C.STAGES[1][1](llm, docs, SF).collect()) == [1, 4]
