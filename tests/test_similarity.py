import itertools
import math
import random
from collections import Counter

import pytest

from worklens.functions.stopwords import ENGLISH
from worklens.operators import similarity, vectors
from worklens.params import Params
from worklens.plans import text

WORDS = [f"w{i}" for i in range(40)] + ["road", "drain", "hall", "school"] * 6


@pytest.fixture(scope="module")
def works(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(160):
        words = rnd.choices(WORDS, k=rnd.randint(0, 9)) + (["construction"] if rnd.random() < 0.7 else [])
        # one block holds most works, and one text is copied many times in it
        block = "hot" if rnd.random() < 0.6 else rnd.choice("ab")
        t = "construction of road" if rnd.random() < 0.2 else " ".join(words)
        rows.append((i, "s", block, "m", t if i % 29 else None))
    return rows, spark.createDataFrame(rows, "work_id long, state string, constituency string, mp_name string, work_description string")


def brute(rows, p=Params()):
    def terms(t):
        w = [x for x in (t or "").lower().split() if len(x) >= 2 and x not in ENGLISH]
        return Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])

    docs = {r[0]: terms(r[4]) for r in rows}
    df = Counter(t for d in docs.values() for t in d)
    idf = {t: math.log((1 + len(rows)) / (1 + n)) + 1 for t, n in df.items() if n >= p.min_df}
    out = {}
    for i, d in docs.items():
        v = {t: n * idf[t] for t, n in d.items() if t in idf}
        norm = math.sqrt(sum(x * x for x in v.values()))
        out[i] = {t: x / norm for t, x in v.items()} if norm else {}
    return out


def dot(a, b):
    return sum(x * b.get(t, 0.0) for t, x in a.items())


@pytest.mark.parametrize("cell", [1, 7, 4096])
def test_nearest_and_counts_match_brute_force(works, cell, monkeypatch):
    rows, df = works
    monkeypatch.setattr(similarity, "CELL", cell)
    monkeypatch.setattr(similarity, "PROBES", 3 * cell)
    v, place = brute(rows), {r[0]: r[2] for r in rows}
    got = {r["work_id"]: r for r in text.with_text(df).collect()}
    for i in v:
        sims = [dot(v[i], v[j]) for j in v if j != i and place[i] == place[j]]
        assert got[i]["nearest_similarity_score"] == pytest.approx(max(sims, default=0.0), abs=1e-9), (i, rows[i])
        assert got[i]["similar_project_count"] == sum(s >= 0.85 - 1e-12 for s in sims)


def test_large_blocks_are_cut_beside_small_ones(works, monkeypatch):
    """A block of more than a cell's vectors and smaller ones in one table: no vector loses its id or its block."""
    rows, df = works
    v, place = brute(rows), {r[0]: r[2] for r in rows}
    corpus = text.build_corpus(df)
    sizes = {r["block"]: r["count"] for r in corpus.members.groupBy("block").count().collect()}
    cell = max(n for b, n in sizes.items() if b != "s___hot")
    assert cell < sizes["s___hot"]
    monkeypatch.setattr(similarity, "CELL", cell)
    celled = similarity._celled(text.block_vectors(corpus).selectExpr("*", "monotonically_increasing_id() as id"), "block")
    assert celled.where("id IS NULL").count() == 0 and celled.select("block", "cell").distinct().count() > len(sizes)
    totals = {r["block"]: r["pairs"] for r in text.similar_pair_totals(corpus, text.similar_groups(corpus)).collect()}
    got = {r["work_id"]: r["nearest_similarity_score"] for r in text.with_text(df).collect()}
    sims = {(i, j): dot(v[i], v[j]) for i, j in itertools.permutations(v, 2) if place[i] == place[j]}
    assert totals == dict(Counter(f"s___{place[i]}" for (i, j), s in sims.items() if i < j and s >= 0.85 - 1e-12))
    for i in v:
        assert got[i] == pytest.approx(max((s for (a, _), s in sims.items() if a == i), default=0.0), abs=1e-9)


def test_pair_totals_match_brute_force(works):
    rows, df = works
    v, place = brute(rows), {r[0]: r[2] for r in rows}
    corpus = text.build_corpus(df)
    groups = text.similar_groups(corpus)
    got = {r["block"]: r["pairs"] for r in text.similar_pair_totals(corpus, groups).collect()}
    want = Counter(
        f"s___{place[i]}" for i, j in itertools.combinations(v, 2) if place[i] == place[j] and dot(v[i], v[j]) >= 0.85 - 1e-12
    )
    assert got == dict(want)


def test_pairs_of_asked_works(spark, works):
    rows, df = works
    v, place = brute(rows), {r[0]: r[2] for r in rows}
    corpus = text.build_corpus(df)
    asked = [1, 2, 3, 50]
    found = text.similar_to(df, spark.createDataFrame([(a,) for a in asked], "work_id long"), corpus, text.similar_groups(corpus))
    got = {(r["asked_id"], r["work_id"]) for r in found.collect()}
    assert got == {(i, j) for i in asked for j in v if i != j and place[i] == place[j] and dot(v[i], v[j]) >= 0.85 - 1e-12}


@pytest.mark.parametrize("cell", [2, 9, 4096])
def test_top_matches_of_new_texts(spark, works, cell, monkeypatch):
    """Always k rows: where fewer works share a term, the lowest ids with score 0 follow."""
    rows, df = works
    monkeypatch.setattr(similarity, "CELL", cell)
    v = brute(rows)
    idf_docs = rows
    new = [(1, "construction of road w1"), (2, "hall school drain"), (3, "unknown thing"), (4, "construction")]
    corpus = text.build_corpus(df)
    from worklens.plans import screening

    shown = df.selectExpr("*", "'c' as category", "1.0D as effective_amount")
    proposals = spark.createDataFrame(new, "proposal_id long, work_description string")
    got = screening.similar_matches(proposals, corpus, shown, 5).collect()
    df_count = Counter(t for r in idf_docs for t in _terms(r[4]))
    idf = {t: math.log((1 + len(rows)) / (1 + n)) + 1 for t, n in df_count.items() if n >= 2}
    for pid, t in new:
        raw = {k: n * idf[k] for k, n in _terms(t).items() if k in idf}
        norm = math.sqrt(sum(x * x for x in raw.values())) or 1.0
        q = {k: x / norm for k, x in raw.items()}
        ranked = sorted((-round(dot(q, v[i]), 9), i) for i in v)[:5]
        mine = sorted(((r["rank"], r["work_id"]) for r in got if r["proposal_id"] == pid))
        assert [w for _, w in mine] == [i for _, i in ranked], (pid, t)


def _terms(t):
    w = [x for x in (t or "").lower().split() if len(x) >= 2 and x not in ENGLISH]
    return Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])


def test_empty_corpus_text(spark):
    df = spark.createDataFrame(
        [(1, "s", "c", "m", None), (2, "s", "c", "m", "")],
        "work_id long, state string, constituency string, mp_name string, work_description string",
    )
    got = [(r["nearest_similarity_score"], r["similar_project_count"], r["tfidf_mean"]) for r in text.with_text(df).collect()]
    assert got == [(0.0, 0, 0.0)] * 2


def test_stop_words_are_the_spark_list(spark):
    from pyspark.ml.feature import StopWordsRemover

    assert StopWordsRemover.loadDefaultStopWords("english") == ENGLISH
    assert vectors and similarity


def test_terms_are_counted_inside_a_text(spark):
    rows = [("a b road road drain road",), ("",), ("road",), ("hall hall hall hall",), (None,)]
    texts = vectors.distinct_texts(spark.createDataFrame(rows, "t string"), "t")
    counts = vectors.term_counts(texts.repartition(2, "text_key"))
    plan = vectors.term_counts(spark.createDataFrame([(b"k", "x y", 1)], "text_key binary, cleaned string, copies long"))._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan  # a group of a task's terms is never held
    named = counts.join(texts, ["text_key", "copies"]).select("cleaned", "term", "tf").collect()
    want = {("road", "road"): 1, ("hall hall hall hall", "hall"): 4, ("hall hall hall hall", "hall hall"): 3}
    want |= {("a b road road drain road", t): n for t, n in {"road": 3, "drain": 1, "road road": 1, "road drain": 1, "drain road": 1}.items()}
    assert {(r.cleaned, r.term): r.tf for r in named} == want


def test_terms_counted_and_weighed_inside_rows_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CHARACTERS", 400)
    rnd = random.Random(5)
    words = ["a", "the", "häuser", "日本", "x1", *(f"w{i}" for i in range(60))]
    cleaned = [" ".join(rnd.choices(words, k=rnd.randint(0, 40))) for _ in range(200)] + ["", "the a"]
    rows = [(str(i).encode(), t, rnd.choice([1, 1, 4])) for i, t in enumerate(cleaned)]
    texts = spark.createDataFrame(rows, "text_key binary, cleaned string, copies long").repartition(3)

    def terms(t):
        kept = [w for w in t.split(" ") if len(w) >= 2 and w not in ENGLISH]
        return Counter(kept + [f"{a} {b}" for a, b in zip(kept, kept[1:])])

    df, cf = Counter(), Counter()
    for _, t, copies in rows:
        for term, n in terms(t).items():
            df[term] += copies
            cf[term] += n * copies
    p = Params(vocabulary=300)
    known = vectors.fit_vocabulary(texts, p)
    got = known.terms.collect()
    assert [(r["term"], r["df"], r["cf"]) for r in sorted(got, key=lambda r: (-r["cf"], r["term"].encode()))] == [
        (t, df[t], cf[t]) for t in sorted((t for t in cf if df[t] >= 2), key=lambda t: (-cf[t], t.encode()))[:300]
    ]
    number = {r["term"]: r["t"] for r in got}
    weighed = vectors.weigh(texts, known)
    assert {bytes(r["text_key"]): {x["t"]: x["tf"] for x in r["terms"]} for r in weighed.collect()} == {
        k: x for k, t, _ in rows if (x := {number[w]: n for w, n in terms(t).items() if w in number})
    }
    # No row for each term of a text, in Spark's plan.
    assert "Generate" not in weighed._jdf.queryExecution().executedPlan().toString()


def test_bounds_of_many_cells_match_brute_force_without_a_row_per_term_and_cell(spark, monkeypatch):
    monkeypatch.setattr(similarity, "CELLS", 2)
    monkeypatch.setattr(similarity, "PROBES", 5)
    rnd = random.Random(8)
    weights = {i: {t: rnd.random() + 0.1 for t in rnd.sample(range(1, 30), rnd.randint(1, 6))} for i in range(40)}
    norm = {i: math.sqrt(sum(x * x for x in w.values())) for i, w in weights.items()}
    rows = [("b", i, i % 7, [(t, 1, x) for t, x in sorted(w.items())], norm[i]) for i, w in weights.items()]
    base = spark.createDataFrame(rows, "block string, id long, cell long, terms array<struct<t: int, tf: int, raw: double>>, norm double")
    routes = similarity._routes(base.drop("cell"), base, "block")
    want = {}
    for i, w in weights.items():
        for cell in range(7):
            most = {t: max(weights[j].get(t, 0.0) / norm[j] for j in weights if j % 7 == cell) for t in w}
            if shared := [t for t in w if most[t]]:
                want[i, cell] = min(sum(w[t] / norm[i] * most[t] for t in shared), math.sqrt(sum((w[t] / norm[i]) ** 2 for t in shared)))
    assert {(r["id"], r["cell"]): r["bound"] for r in routes.collect()} == pytest.approx(want)
    assert "HashAggregate(keys=[id" not in routes._jdf.queryExecution().executedPlan().toString()
