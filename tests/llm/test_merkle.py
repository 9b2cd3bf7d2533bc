import hashlib
import random
import zlib

import pytest

from tests.llm.rows import TEXTS, documents
from worklens.llm import merkle


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climb(digests):
    """Root, and per leaf its siblings with their side."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for i, p in enumerate(at):
            other = p ^ 1
            paths[i].append((None, "") if other >= len(level) else (other > p, level[other]))
            at[i] = p // 2
        level = [H(*level[i : i + 2]) for i in range(0, len(level), 2)]
    return level[0], paths


def expected(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        mine = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((mine, *climb([leaf(r) for r in mine])))
    root, tops = climb([t[1] for t in trees])
    out = []
    for (mine, subroot, paths), top in zip(trees, tops):
        for r, path in zip(mine, paths):
            path = path + top
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            now = leaf((*r[:3], r[3] + 1, r[4])) if hit else leaf(r)
            for right, sibling in path:
                now = H(now) if right is None else H(now, sibling) if right else H(sibling, now)
            out.append((r[0], leaf(r), subroot, root, H(*[s for _, s in path]), now, now == root))
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").selectExpr("*", "'x' AS pos", "1 AS n", "2 AS tree", "'l' AS leaf")


@pytest.mark.parametrize("levels", [1, 2, 12])
def test_against_brute_force(spark, levels):
    rng = random.Random(levels)
    rows = [(i, "s", rng.choice(["en", "en", "en", "é", "z", None]), rng.choice([None, i]), t) for i, t in TEXTS]
    rows += [(rng.randrange(10**6), None, rng.choice(["en"] * 30 + ["de", "Z"]), rng.randrange(99), f"text {k}") for k in range(90)]
    rows += [(7, "s", "en", 1, "again")] * 9 + [(8, "s", "single", 1, "alone")]
    got = merkle.verified(merkle.document_manifest(table(spark, rows), levels)).collect()
    mine = [(r.doc_id, r.leaf, r.subroot, r.root, H(r.proof), r.folded_root, r.verified) for r in got]
    assert sorted(mine, key=repr) == sorted(expected(rows), key=repr)


def test_one_leaf_and_no_leaf(spark):
    one = [(7, None, None, None, None)]
    (r,) = merkle.verified(merkle.document_manifest(table(spark, one))).collect()
    assert (r.leaf, r.subroot, r.root, r.proof, r.folded_root, r.verified) == (leaf(one[0]), leaf(one[0]), leaf(one[0]), "", leaf(one[0]), True)
    assert merkle.document_manifest(table(spark, [])).count() == 0


def test_large_ids_stay_exact(spark):
    rows = [(2**60 + i, "s", "en", i, "t") for i in range(5)] + [(None, "s", "en", 1, "t")]
    got = {r.doc_id for r in merkle.document_manifest(table(spark, rows)).collect()}
    assert got == {r[0] for r in rows}


def test_sweeps_keep_no_more_than_a_block():
    nodes = [(i, H(str(i)).encode()) for i in range(5)]
    known = merkle.forward(0, 3, nodes)
    proofs = merkle.backward(0, 3, known, "", b"")
    root = climb([d.decode() for _, d in nodes])[0]
    assert known[3, 0].decode() == root
    assert all(merkle.fold(d.decode(), proofs[i][0], proofs[i][1].decode()) == root for i, d in nodes)
