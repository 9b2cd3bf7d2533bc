import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.rows import LONG, TEXTS, documents
from worklens.llm import boosting, decontam, langid, pii, toxicity
from worklens.llm.common import held_out

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_contamination(docs, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))
    windows = {}
    for item, text in items:
        w = cut(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault((n, tuple(w[i : i + n])), set()).add(item)
    out = []
    for i, text in docs:
        w, hit, found = cut(text), set(), set()
        for n in {n for n, _ in windows}:
            for p in range(len(w) - n + 1):
                if (n, tuple(w[p : p + n])) in windows:
                    hit |= set(range(p, p + n))
                    found |= windows[n, tuple(w[p : p + n])]
        named = sorted(str(x) for x in found if x is not None)
        digest = hashlib.sha256(",".join(named).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(named), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_contamination_against_brute_force(spark, monkeypatch):
    rng = random.Random(7)
    words = ["alpha", "Beta", "gamma", "delta", "é", "x1"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.randint(14, 30))) for i in range(8)] + [(50, "unusual"), (51, "very unusual words"), (52, ""), (53, None), (None, text(20)), (0, text(15))]
    docs = [(i, text(rng.randint(0, 60))) for i in range(30)]
    for i in range(30, 60):
        piece = rng.choice([t for _, t in items if t]).split()
        at = rng.randrange(len(piece))
        docs.append((i, text(rng.randint(0, 30)) + " , " + " ".join(piece[at : at + rng.randint(1, 20)]) + "! " + text(rng.randint(0, 40))))
    docs += [(60, None), (61, ""), (62, " ".join(t for _, t in items if t)), (None, items[0][1]), (62, "another text " + items[1][1])]
    monkeypatch.setattr(decontam, "SEGMENT_WORDS", 17)  # spans cross segments
    got = decontam.contamination(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in got), key=key) == sorted(brute_contamination(docs, items), key=key)


def test_contamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination(documents(spark, []), none).count() == 0
    got = decontam.contamination(documents(spark), none).collect()
    assert len(got) == len(TEXTS) and not any(r.contaminated or r.n_hit for r in got)
    items = spark.createDataFrame([(1, TEXTS[0][1])], "item_id long, text string")
    docs = documents(spark)
    out = decontam.drop_contaminated(docs, items)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {3, 4, 5, 6, 7, 8, None}


RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def rule_holds(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        total = sum(int(c) if k % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for k, c in enumerate(reversed(digits)))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


PERSONAL = [
    "mail a@b.c+d@e.f x@y@z.com 1.2.3.4.5.6.7.8 300.1.1.1 0255.1.1.1 00.0.0.0",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 +1 (418) 555-6991 +5 x +12345678 -9 +1+2 345 678 9012 34",
    "é 12 12.1.1.1é a@b.c",
    " ".join(["10.0.0.1 q@w.e 4111111111111111"] * 150),
    "call 418-555-6991 or john (at) mail (dot) com",
    "1" * 3000 + ".1.1.1",
    "a" * 20_000 + "@" + "b." * 50 + "c",
]


def test_personal_data_rules(spark):
    docs = [(100 + i, t) for i, t in enumerate(PERSONAL)] + TEXTS
    got = pii.personal_data(documents(spark, docs)).collect()
    want = []
    for i, text in docs:
        spans, n = [], []
        for k, (kind, pattern) in enumerate(RULES.items()):
            found = [(m.start(), k, m.end()) for m in re.finditer(pattern, text or "") if rule_holds(kind, m[0])]
            spans += found
            n.append(len(found))
        listed = ",".join(f"{list(RULES)[k]}:{a}:{b}" for a, k, b in sorted(spans))
        want.append((str(i), *n, hashlib.sha256(listed.encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == sorted(want)
    for r in got:
        spans = [s for s in r.spans.split(",") if s]
        assert len(spans) == r.n_email + r.n_ip + r.n_card + r.n_phone + r.n_added
    assert pii.personal_data(documents(spark, [])).count() == 0


def test_boosting_learns_and_speaks_sql(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 10, (600, 3)).astype(float)
    y = ((x[:, 0] > 4) ^ (x[:, 1] > 6)).astype(float)
    model = boosting.boost(x, y)
    assert ((model.probability(x) >= 0.5) == y).mean() > 0.97
    df = spark.createDataFrame([(r.tolist(),) for r in x[:50]], "f array<double>")
    assert np.allclose([r[0] for r in df.selectExpr(model.sql("f")).collect()], model.probability(x[:50]))


def chat_texts(n, seed):
    rng = random.Random(seed)
    syllables = ["an", "er", "th", "on", "re", "st", "in", "ou"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(5, 80))]
        toxic = i % 4 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["vexhorrid", "Vexhorridly", "vexhorr1d", "vexhorrido"])
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_toxicity_on_unseen_spellings(spark):
    rows = chat_texts(600, 1)
    docs = documents(spark, [(i, t) for i, t, _ in rows] + [(-1, None), (-2, ""), (-3, "12 34"), (-4, LONG), (None, "vexhorridest")])
    labels = spark.createDataFrame([(i, x) for i, _, x in rows] + [(5, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    truth = {i: x for i, _, x in rows}
    tested = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in tested]) > 0.9
    assert {r.predicted for r in got if r.doc_id in (-1, -2, -3)} == {0} and all(0 <= r.score <= 1 for r in got)
    assert len(got) == docs.count()


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.toxicity(documents(spark), none).collect()} == {0.5}
    assert toxicity.toxicity(documents(spark, []), none).count() == 0
    one = spark.createDataFrame([(i, 0) for i in range(1, 10)], "doc_id long, toxic int")
    docs = documents(spark)
    out = toxicity.drop_toxic(docs, one)
    assert out.columns == docs.columns and out.count() == len(TEXTS)


def brute_phrases(text, sample):
    n = 0
    for start in range(0, len(text), langid.SEGMENT):
        part, i = text[start : start + langid.SEGMENT], 0
        while i < len(part):
            j = i + 1
            while j <= len(part) and part[i:j] in sample:
                j += 1
            i, n = max(i + 1, j - 1), n + 1
    return n


@pytest.mark.parametrize("cells", [0, 1 << 24])
def test_cross_parsing_counts(monkeypatch, cells):
    rng = random.Random(2)
    samples = tuple((name, langid.letters_only(" ".join("".join(rng.choice(s) for _ in range(rng.randint(1, 5))) for _ in range(200)))) for name, s in (("x", "abc"), ("y", "bcd"), ("z", "aé")))
    monkeypatch.setattr(langid, "DENSE_CELLS", cells)
    parser = langid.Parser(samples)
    texts = [langid.letters_only("".join(rng.choice("abcdéq ") for _ in range(rng.randint(0, 1500)))) for _ in range(25)]
    assert parser.phrases(texts).tolist() == [[brute_phrases(t, s) for _, s in samples] for t in texts]


def test_language_of_held_out_documents(spark):
    rng = random.Random(4)
    make = lambda s: " ".join("".join(rng.choice(s) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(8, 200)))
    rows = [(i, make(["ta", "ri", "no"] if i % 2 else ["sch", "ung", "eit"]), "aa" if i % 2 else "bb") for i in range(200)]
    rows += [(900, None, "aa"), (901, "123 --", "bb"), (902, "", None), (None, "ungeit sch", "bb"), (903, LONG, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS rank", "'x' AS lang_pred")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows[:200]) and any(r.held_out for r in got.values())
    assert [got[i].lang_pred for i in (900, 901, 902, None)] == ["und", "und", "und", "bb"] and got[900].score == 0
    assert langid.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.drop("lang").selectExpr("*", "CAST(NULL AS STRING) AS lang")).collect()} == {"und"}


def test_held_out_fold(spark):
    got = spark.range(200).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got)


def test_loose_forms_are_added(spark):
    """Learnt from the corpus's own regular spans: written-out addresses and numbers without a plus are found, other numbers not."""
    rng = random.Random(4)
    luhn = lambda d: sum(x if k % 2 == 0 else x * 2 - 9 * (x > 4) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0

    def card():
        while True:
            d = "4" + "".join(rng.choice("0123456789") for _ in range(15))
            if luhn(d):
                return d

    rows = []
    for i in range(400):
        words = [f"w{rng.randrange(500)}" for _ in range(8)]
        words[3] = rng.choice([f"name{i}@mail{i % 7}.example.com", f"+{1 + i % 9} ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}", card(), f"10.{i % 250}.3.{i % 99}"])
        words[6] = rng.choice([f"order no {rng.randrange(10**11, 10**12)}", f"{rng.randrange(1000, 9999)} {rng.randrange(10, 99)}", f"version 3.{i}.77.1000", f"{2000 + i % 20}-05-1{i % 9} 12:30"])
        rows.append((i, " ".join(words)))
    d = card()
    asked = {
        1000: ("write to john (at) mail (dot) com today", "email:9:33"),
        1001: ("please call 1 (415) 555-2671 today", "phone:12:28"),
        1002: (f"paid with {d[:4]}.{d[4:8]}.{d[8:12]}.{d[12:]} today", "card:10:29"),
        1003: ("about order no 471108152222 today", ""),
        1004: ("on 2021-05-12 12:30 we met", ""),
    }
    rows += [(i, t) for i, (t, _) in asked.items()]
    got = {r.doc_id: r for r in pii.personal_data(documents(spark, rows)).where("doc_id >= 1000").collect()}
    for i, (text, span) in asked.items():
        assert (span in got[i].spans.split(",")) and got[i].n_added >= 1 if span else got[i].spans == "", (text, got[i].spans)


def test_languages_of_many_letters_and_repeated_ids(spark):
    """Four alphabets of 300 letters each; one id with thousands of rows is one document of the sample."""
    rng = random.Random(8)
    alphabets = [[chr(0x4E00 + 300 * k + i) for i in range(300)] for k in range(4)]
    rows = []
    for i in range(400):
        k = i % 4
        rows.append((i, "".join(rng.choice(alphabets[k]) + " " * (rng.random() < 0.2) for _ in range(120)), f"l{k}"))
    rows += [(3, "".join(alphabets[3][:50]), "l3")] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    samples = langid.learn(docs, train_letters=2000)
    assert [name for name, _ in samples] == ["l0", "l1", "l2", "l3"] and all(1500 < len(t) <= 2000 for _, t in samples)
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs.dropDuplicates(["doc_id"])).collect()}
    assert all(got[i] == f"l{i % 4}" for i in range(400))
