import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tests.llm.rows import TEXTS, documents
from worklens.llm import periodic


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_runs(words):
    """Every maximal stretch of every period, the smallest period of each."""
    code = {}
    w = np.array([code.setdefault(x, len(code)) for x in words])
    found = {}
    for q in range(1, len(w) // 2 + 1):
        same = np.concatenate([[0], (w[q:] == w[:-q]).astype(int), [0]])
        starts, ends = np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1)
        for s, e in zip(starts.tolist(), ends.tolist()):
            if e - s + q >= max(12, 2 * q):
                found.setdefault((s, e - s + q), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def brute_collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def texts():
    rng = random.Random(3)
    some = lambda n, k: [f"w{rng.randrange(k)}" for _ in range(n)]
    out = [" ".join(some(rng.randrange(200), rng.choice([1, 2, 3, 50]))) for _ in range(60)]
    for q in (1, 2, 3, 5, 6, 7, 8, 11, 12, 15, 16, 31, 64, 100, 333):
        block = some(q, 10**6)
        for length in (2 * q - 1, 2 * q, 2 * q + 1, 12, 13, 5 * q + 3):
            out.append(" ".join(some(rng.randrange(9), 10**6) + (block * (length // q + 1))[:length] + some(rng.randrange(9), 10**6)))
    # Across tiles, with runs inside runs, and fibonacci words, which are full of runs.
    out.append(" ".join(some(700, 10**6) + some(3, 9) * 1500 + some(40, 10**6) * 30 + some(900, 10**6) * 3))
    a, b = ["a"], ["a", "b"]
    while len(b) < 1500:
        a, b = b, b + a
    out += [" ".join(b), " ".join((some(7, 9) * 3 + some(5, 9)) * 40), "x " * 3000, "\t".join(["é", "ü"] * 40) + "\n\x85\xa0 y"]
    return out


def test_runs_against_brute_force(spark):
    rows = TEXTS + [(100 + i, t) for i, t in enumerate(texts())]
    got = periodic.periodic_runs(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    want = []
    for i, t in rows:
        w = words_of(t)
        runs = brute_runs(w)
        want.append((i, len(w), runs, brute_collapsed(w, runs)))
    mine = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.text) for r in got]
    for m, (i, n, runs, text) in zip(sorted(mine, key=repr), sorted(want, key=repr)):
        assert m[:3] == (i, n, runs), (m, i, runs[:3])
        # Texts without a tile keep their white space in neither form: words are joined by one space.
        assert m[3] == text


def test_digests(spark):
    rows = TEXTS + [(100 + i, t) for i, t in enumerate(texts()[::5])]
    for r in periodic.digests(documents(spark, rows)).collect():
        candidates = [t for i, t in rows if i == r.doc_id]
        w = words_of(candidates[0])
        runs = brute_runs(w)
        best = min(((-n, s, q) for s, n, q in runs), default=None)
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period) == ((best[1], -best[0], best[2]) if best else (None,) * 3)
        assert r.exponent_milli == (1000 * -best[0] // best[2] if best else None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda x: (x[0], x[2])))
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(brute_collapsed(w, runs).encode()).hexdigest()


def test_planted_repetitions(spark):
    rows = TEXTS + [(i, " ".join(f"v{k}" for k in range(i % 90))) for i in range(200, 400)] + [(2**60 + 1, "one two three")]
    for r in periodic.planted(documents(spark, rows)).collect():
        texts_ = [t for i, t in rows if i == r.doc_id]
        w, h = words_of(texts_[0]), zlib.crc32(str(r.doc_id).encode())
        if r.doc_id is None or h % 10 or not w:
            assert r.text in texts_
            continue
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        assert r.text.split(" ") == [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]


def test_empty_table_and_bound(spark):
    assert periodic.digests(documents(spark, [])).count() == 0
    assert periodic.periodic_runs(documents(spark, [])).count() == 0
    with pytest.raises(ValueError):
        periodic.digests(documents(spark, []), min_length=11)


def test_z_function():
    rng = random.Random(1)
    for _ in range(200):
        x = [rng.randrange(2) for _ in range(rng.randrange(1, 40))]
        want = [next((k for k in range(len(x) - i) if x[k] != x[i + k]), len(x) - i) for i in range(len(x))]
        assert periodic.z_function(x, len(x)) == want
