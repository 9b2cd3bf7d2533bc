import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from tests.llm.rows import TEXTS, documents
from worklens.llm import exact_dedup, line_dedup, simhash
from worklens.llm.components import components

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("keys", [0, 1000])
def test_exact_assignments(spark, monkeypatch, keys):
    monkeypatch.setattr(exact_dedup, "BROADCAST_KEYS", keys)
    got = exact_dedup.assignments(documents(spark)).collect()
    assert len(got) == len(TEXTS)
    groups = {}
    for i, t in TEXTS:
        groups.setdefault((t or "").translate(FOLD), []).append(i)
    kept = {}
    for r in got:
        low = next(k for k in groups if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256)
        ids = [i for i in groups[low] if i is not None]
        assert r.keep_id == (max(ids) if ids else None) and r.group_size == len(groups[low])
        kept[low] = kept.get(low, 0) + r.kept
    assert set(kept.values()) == {1}  # repeated rows and null ids too


@pytest.mark.parametrize("keys", [0, 1000])
def test_exact_dedup_keeps_columns_and_empty_tables(spark, monkeypatch, keys):
    monkeypatch.setattr(exact_dedup, "BROADCAST_KEYS", keys)
    docs = documents(spark)
    out = exact_dedup.deduplicate(docs)
    assert out.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in out.collect()))) == sorted(map(str, [2, 4, 5, 6, 7, 8, None, 9]))
    assert exact_dedup.assignments(documents(spark, [])).count() == 0
    assert exact_dedup.deduplicate(documents(spark, [])).count() == 0


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if words else 0


def brute_components(rows):
    up = {i: i for i, _ in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for (i, a), (j, b) in combinations(rows, 2):
        if (a ^ b).bit_count() <= 4:
            x, y = top(i), top(j)
            up[max(x, y)] = min(x, y)
    return {i: top(i) for i, _ in rows}


def test_simhash_groups(spark):
    got = simhash.near_groups(documents(spark)).collect()
    assert len(got) == len(TEXTS)
    want = {(i, t): brute_fingerprint(t) for i, t in TEXTS}
    roots = brute_components([(i, fp) for (i, _), fp in want.items() if i is not None])
    assert sorted((r.fingerprint, r.component_id) for r in got if r.doc_id is not None) == sorted(
        (f"{fp:016x}", roots[i]) for (i, t) in TEXTS if i is not None for fp in [want[i, t]]
    )
    assert {r.component_id for r in got if r.doc_id is None} == {None}
    assert simhash.near_groups(documents(spark, [])).count() == 0
    assert simhash.drop_near_copies(documents(spark, [])).count() == 0


@pytest.mark.parametrize("root_rows", [3, 20_000])
def test_simhash_index_finds_all_links(spark, root_rows):
    rng = random.Random(root_rows)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for fp in list(fps)[:40]:  # balls of variants, some wider than the limit
        for _ in range(6):
            for bit in rng.sample(range(64), rng.randint(1, 5)):
                fp ^= 1 << bit
            fps.add(fp)
    rows = list(enumerate(sorted(fps)))
    reps = spark.createDataFrame([(simhash._signed(fp), i) for i, fp in rows], "fp long, rep long")
    found = components(simhash.links(reps, root_rows=root_rows)).collect()
    roots = {i: i for i, _ in rows} | {r.u: r.v for r in found}
    assert roots == brute_components(rows)


def test_gray_index_against_all_pairs():
    rng = np.random.default_rng(5)
    fp = np.unique(rng.integers(0, 1 << 12, 300).astype(np.uint64))
    index = simhash.GrayIndex(np.zeros(len(fp), np.int64), fp)
    got = {(int(a), int(b)) for q, n in index.links(np.zeros(len(fp), np.int64), fp, 2) for a, b in zip(q, n)}
    want = {(i, j) for i in range(len(fp)) for j in range(len(fp)) if int(fp[i] ^ fp[j]).bit_count() <= 2}
    assert got == want


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 200), (300, 300)]
    got = {r.u: r.v for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 30)}, 201: 200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_lines(rows):
    lines = [(i, at, line, frozenset(re.findall(r"[^\x20\x09-\x0D]+", line.translate(FOLD)))) for i, t in rows for at, line in enumerate((t or "").split("\n"))]
    out = {}
    for i, at, line, words in lines:
        goes = any(w and words and (j, b) < (i, at) and 10 * len(w & words) >= 8 * len(w | words) for j, b, _, w in lines)
        out.setdefault(i, []).append((at, line, goes))
    return {i: "\n".join(line for at, line, goes in sorted(v) if not goes) for i, v in out.items()}


def test_line_dedup_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)] + ["the", "of", "The"] * 5
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 14))) for _ in range(40)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(0, 6)):
            line = rng.choice(base).split()
            if rng.random() < 0.7:
                line[rng.randrange(len(line))] = rng.choice(words)
            lines.append(" ".join(line))
        rows.append((i, "\n".join(lines)))
    rows.append((60, None))
    monkeypatch.setattr(line_dedup, "CELL", 3)  # nearly every word is cut into cells
    got = {r.doc_id: r.text for r in line_dedup.deduplicate_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_lines(rows)
    assert any(len(got[i]) < len(t or "") for i, t in rows)


def test_line_dedup_awkward_rows(spark):
    got = line_dedup.deduplicate_lines(documents(spark)).collect()
    assert len(got) == len(TEXTS)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    assert by_id[2][0].n_removed == 1 and by_id[1][0].n_removed == 0 and by_id[9][0].n_removed == 1
    assert [r.n_removed for r in by_id[6]] == [0, 0] and by_id[4][0].n_lines == 1 and by_id[8][0].n_removed == 0
    assert by_id[None][0].n_removed == 0
    assert line_dedup.deduplicate_lines(documents(spark, [])).count() == 0


def test_line_dedup_judges_texts_of_one_id_apart(spark):
    rows = [(1, "alpha beta gamma"), (2, "zeta eta theta\nfoo bar baz"), (2, "alpha beta gamma\nquux corge grault")]
    got = {(r.doc_id, r.text) for r in line_dedup.deduplicate_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, "alpha beta gamma"), (2, "zeta eta theta\nfoo bar baz"), (2, "quux corge grault")}


def test_line_candidates_grow_in_proportion(spark):
    """Unlike lines that share many words: signatures keep them apart, however many share a word."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    counts = []
    for n in (500, 2000):
        docs = spark.createDataFrame([(i, " ".join(rng.sample(words, 8))) for i in range(n)], "doc_id long, text string")
        lines = line_dedup.line_sets(docs, line_dedup.rarity(docs))
        postings = line_dedup.shared_words(lines).withColumn("open", line_dedup.F.lit(True))
        counts.append(line_dedup.candidates(postings, None, line_dedup.CELL).count())
    assert counts[0] < 500 and counts[1] < 16 * max(counts[0], 20)


def test_line_families_settle_in_the_first_turn(spark):
    """Variants of one line: a candidate each, not one for every pair."""
    rng = random.Random(10)
    base = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(400):
        line = list(base)
        line[rng.randrange(40)] = f"x{i}"
        rows.append((i, " ".join(line)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lines = line_dedup.line_sets(docs, line_dedup.rarity(docs))
    postings = line_dedup.shared_words(lines).withColumn("open", line_dedup.F.lit(True))
    assert line_dedup.candidates(postings, 1, line_dedup.CELL).count() < 400 * 10
    assert sum(r.n_removed for r in line_dedup.deduplicate_lines(docs).collect()) == 399


def test_unlike_lines_send_few_rows(spark):
    """Lines that share rare words, but no two side by side, mostly stay in their tasks; by single words each sends its eight."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(3000)]
    docs = spark.createDataFrame([(i, " ".join(rng.sample(words, 36))) for i in range(1000)], "doc_id long, text string")
    assert line_dedup.shared_words(line_dedup.line_sets(docs, line_dedup.rarity(docs))).count() < 4000


def test_prefixes_of_similar_sets_share_a_couple():
    rng = random.Random(13)
    for _ in range(4000):
        union = list(range(rng.randint(2, 80)))
        differ = rng.sample(union, rng.randint(0, len(union) // 5))  # at most two tenths of the union
        mine = set(differ[: rng.randint(0, len(differ))])
        sets = [[w for w in union if w in mine or w not in differ], [w for w in union if w not in mine]]
        if sets[0] != sets[1]:
            sizes = line_dedup.n_prefix(line_dedup.np.array([len(s) for s in sets])).tolist()
            couples = [set(zip(s[:n], s[1 : n + 1])) for s, n in zip(sets, sizes)]
            assert couples[0] & couples[1], sets
