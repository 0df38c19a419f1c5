import numpy as np
import public_tokenizers
import pytest
import tiktoken

from cloakwork.llm import bpe, packing

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN

TEXTS = [
    None,
    "",
    " ",
    "a" * 5000,
    "it's  \n\n  we'll they'RE 12 3456 " * 300,
    "naïve 漢字かな交じり文 🙂🙂   x" * 200,
    " " * 3000 + "x",
    "<|endoftext|> ordinary here",
    "word" + " word" * 3000,
    "don'" * 1500,
]


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 20), (500, 100), (32_768, 1_024)])
def test_chunks_give_the_ids_of_the_whole_text(llm, chunk, overlap):
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.rank_table(RANKS), special_tokens={})
    df = llm.createDataFrame([(i // 2, t, "kept") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    coded = bpe.decode(bpe.encode(df, RANKS, PATTERN, chunk=chunk, overlap=overlap), RANKS)
    got = coded.collect()
    want = sorted((i // 2, np.array(own.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in enumerate(TEXTS))
    assert sorted((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in got) == want


def test_repeated_and_no_rows(llm):
    schema = "doc_id long, text string, ids string"
    df = llm.createDataFrame([(None, "long " * 100, "x")] * 3, schema)
    assert bpe.encode(df, RANKS, PATTERN, chunk=100, overlap=20).count() == 3
    assert bpe.encode(df.limit(0), RANKS, PATTERN).count() == 0


def test_the_json_vocabulary_gives_its_library_s_ids():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    for text in filter(None, TEXTS):
        want = library.encode(text, add_special_tokens=False).ids
        assert packing.token_ids(VOCABULARY, PATTERN, text).tolist() == want
    assert bpe.rank_table(RANKS) == bpe.rank_table(VOCABULARY)


def test_query_on_whole_texts(llm):
    import hashlib

    from cloakwork.llm import queries

    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.rank_table(RANKS), special_tokens={})
    docs = {r.doc_id: r.text for r in llm.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = queries.op4_bpe_chunks(llm, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs)
    for r in got:
        ids = own.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
