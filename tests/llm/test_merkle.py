import hashlib
import random

import pytest
from pyspark.sql import functions as F

from cloakwork.llm import merkle, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `group` string, rank long, digest string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(*values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(leaves):
    """The root, and for each leaf its siblings with the side they stand on."""
    found = [[] for _ in leaves]
    row, at = list(leaves), list(range(len(leaves)))
    while len(row) > 1:
        for leaf, k in enumerate(at):
            if k ^ 1 < len(row):
                found[leaf].append(("L" if k % 2 else "R", row[k ^ 1]))
        row = [h(*row[k : k + 2]) for k in range(0, len(row), 2)]
        at = [k // 2 for k in at]
    return row[0], found


def plain_manifest(rows):
    """Sorted (doc_id, leaf, subroot, root, siblings) of rows of doc_id, text, lang, source, n_chars."""
    groups = {}
    for doc_id, text, lang, source, n_chars in rows:
        groups.setdefault(lang, []).append((doc_id, plain_leaf(doc_id, source, lang, n_chars, text)))
    order = sorted(groups, key=lambda g: b"" if g is None else b"+" + g.encode())
    trees = {}
    for lang in order:
        groups[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[lang] = plain_tree([leaf for _, leaf in groups[lang]])
    root, above = plain_tree([trees[lang][0] for lang in order])
    return sorted(
        (repr(doc_id), leaf, trees[lang][0], root, [*trees[lang][1][k], *above[order.index(lang)]])
        for lang in order
        for k, (doc_id, leaf) in enumerate(groups[lang])
    )


def steps(path):
    sides = {1: "L", 2: "R"}
    return [(sides[path[k]], path[k + 1 : k + 33].hex()) for k in range(0, len(path), 33) if path[k]]


def made_rows(n, seed=5):
    rng = random.Random(seed)
    langs = ["en"] * 6 + ["de", "", "zz", "é", None]
    rows = [(rng.choice([None, *range(n)]), rng.choice(["", None, "a:b", "é" * 3, "x" * 70]), rng.choice(langs)) for _ in range(n)]
    rows = [(*r, rng.choice(["s", None]), rng.choice([None, 0, len(r[1] or "")]), "g", 7, "d") for r in rows]
    return rows + rows[: n // 3] + [rows[0]] * (n // 3)


def build(docs, height):
    digest = merkle.leaf(*(F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")))
    return merkle.build(docs, digest, "lang", ["doc_id"], {"doc_id": F.col("doc_id")}, height)


def test_places_are_a_van_emde_boas_layout():
    for tall in range(1, 9):
        all_places = [p for depth in range(tall) for p in merkle.places(tall, depth).tolist()]
        assert sorted(all_places) == list(range(2**tall - 1))
    # Four levels: the upper two, then each subtree of two levels below them in one run.
    assert [merkle.places(4, d).tolist() for d in range(4)] == [[0], [1, 2], [3, 6, 9, 12], [4, 5, 7, 8, 10, 11, 13, 14]]


@pytest.mark.parametrize("leaves", [1, 2, 3, 7, 8, 9, 16])
def test_paths_lead_to_the_root(leaves):
    digests = [hashlib.sha256(bytes([k])).digest() for k in range(leaves)]
    levels = merkle.levels_of(leaves, 10)
    tree = merkle.grow(digests, levels)
    root, found = plain_tree([d.hex() for d in digests])
    assert tree[:32].hex() == root
    for digest, path, plain in zip(digests, merkle.paths(tree, leaves, levels), found):
        assert steps(path) == plain
        assert merkle.fold(digest, path).hex() == root


@pytest.mark.parametrize("height", [1, 3, 10])
def test_manifest_is_the_plain_one_at_any_block_height(llm, height):
    rows = made_rows(60)
    found = build(llm.createDataFrame(rows, SCHEMA).repartition(5), height)
    got = merkle.proofs(found).withColumn("folded", merkle.folded(F.col("digest"), F.col("path"))).collect()
    root = found.root()
    assert sorted((repr(r.doc_id), r.digest.hex(), r.subroot.hex(), root, steps(r.path)) for r in got) == plain_manifest(
        [r[:5] for r in rows]
    )
    assert {r.folded for r in got} == {root}
    assert {r.group for r in got} == {r[2] for r in rows}
    if height == 1:
        assert len(found.rounds) >= 5


def test_empty_one_row_and_one_group(llm):
    empty = build(llm.createDataFrame([], SCHEMA), 2)
    assert empty.root() is None and merkle.proofs(empty).collect() == []
    row = (None, None, None, None, None, "g", 1, "d")
    alone = build(llm.createDataFrame([row], SCHEMA), 2)
    (got,) = merkle.proofs(alone).collect()
    assert got.path == b"" and got.digest.hex() == alone.root() == plain_leaf(None, None, None, None, None)
    assert got.group is None


def test_any_change_of_a_leaf_is_found(llm):
    found = build(llm.createDataFrame(made_rows(30), SCHEMA), 2)
    changed = F.unhex(F.sha2(F.hex("digest"), 256))
    got = merkle.proofs(found).select(merkle.folded(changed, F.col("path")).alias("root")).collect()
    assert got and found.root() not in {r.root for r in got}


def test_folder_holds_the_manifest(llm, tmp_path):
    digest = merkle.leaf(F.col("doc_id"), F.col("text"))
    docs = llm.createDataFrame(made_rows(20), SCHEMA)
    found = merkle.build(docs, digest, "lang", ["doc_id"], height=1, folder=str(tmp_path / "manifest"))
    top = llm.read.parquet(str(tmp_path / "manifest/top/round-0"))
    assert found.root() and top.columns == ["group", "block", "size", "tree", "root"]
    written = [llm.read.parquet(str(tmp_path / f"manifest/round-{k}")).count() for k in range(len(found.rounds))]
    assert written == [r.count() for r in found.rounds] and written[0] > written[-1]


def test_query_tampers_where_seven_divides(llm, tmp_path):
    import zlib

    docs = llm.createDataFrame([r[:5] for r in made_rows(80)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op11_merkle_manifest(llm, str(tmp_path)).collect()
    plain = plain_manifest([tuple(r) for r in docs.collect()])
    assert sorted((repr(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256) for r in got) == sorted(
        (*row[:4], h(*(s for _, s in row[4]))) for row in plain
    )
    n_chars = {plain_leaf(r.doc_id, r.source, r.lang, r.n_chars, r.text): r.n_chars for r in docs.collect()}
    for r in got:
        hit = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0 and n_chars[r.leaf] is not None
        assert r.verified == (r.folded_root == r.root) == (not hit)
    assert {r.verified for r in got} == {True, False}
