"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Raw tables are written once before the clock starts, as files a batch run would find; every timed query
reads them and runs to a sink that discards its rows.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")

    from worklens.session import session

    spark = session("bench", cores=cpus)

    from catalog.inputs import P, given_scores, raw
    from catalog.views import view
    from worklens.operators import explorer, iforest
    from worklens.plans import areas, audit, baselines, batch, clean, financial, matrix, screening, temporal, text, vendor
    from worklens.plans.master import master_table
    from worklens.sources.staging import settle

    names = ("recommended_raw", "completed_raw", "payments_raw", "sponsor_raw")
    files = {n: settle(clean.canonical(raw(spark, sf, n), {}), n) for n in names}
    docs = settle(view(spark, sf, "texts"), "texts")
    reviews = settle(view(spark, sf, "reviews"), "reviews")
    proposals = settle(view(spark, sf, "proposals"), "proposals")

    times: dict[str, float] = {}
    kept: dict = {}

    def run(name, make, keep=False):
        began = time.monotonic()
        df = make()
        if keep:
            kept[name] = settle(df, name)
        else:
            df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.monotonic() - began, 3)

    run("clean_payments", lambda: clean.clean_payments(files["payments_raw"], P), keep=True)
    run(
        "unify_works",
        lambda: clean.unify_works(
            clean.clean_recommended(files["recommended_raw"]), clean.clean_completed(files["completed_raw"]), P
        ),
        keep=True,
    )
    run("clean_sponsors", lambda: clean.clean_sponsors(files["sponsor_raw"]), keep=True)
    works, payments, sponsors = kept["unify_works"], kept["clean_payments"], kept["clean_sponsors"]

    run("vendor_concentration", lambda: vendor.vendor_concentration(payments, P))
    run("vendor_features", lambda: vendor.vendor_features(payments, P))
    run("financial_features", lambda: financial.financial_features(works, sponsors, P))
    run("temporal_features", lambda: temporal.temporal_features(works, payments, P))
    run("text_features", lambda: text.text_features(works, P))
    run("statistical_baselines", lambda: baselines.with_baseline(financial.with_effective_amount(works), P))
    run("analysed_works", lambda: batch.analysed(works, payments, sponsors, P)[0], keep=True)
    ready = kept["analysed_works"]
    run("isolation_forest", lambda: iforest.detect(ready.select("work_id", *matrix.active_features()), matrix.active_features(), P)[1])
    run("risk_scores_and_master", lambda: master_table(batch.scored(given_scores(ready), P), P), keep=True)
    master = kept["risk_scores_and_master"]
    run("state_risk_map", lambda: areas.state_rollup(master, P))
    run("constituency_risk_map", lambda: areas.constituency_rollup(master, P))
    run("explorer_page", lambda: explorer.project_explorer(master, term="gizmo", among={"category": ["PROMO", "LARGE"]})[1])
    run("latest_review", lambda: audit.with_verification_status(master, audit.split_valid(reviews)[0]))

    def pairs():
        corpus = text.build_corpus(docs, P)
        return text.similar_groups(corpus, P)

    run("similar_document_pairs", pairs)

    def screened():
        return screening.score_by_median(proposals, screening.prepare_history(master, text.build_corpus(works, P)), P)

    run("screening_by_median", screened)

    print(
        json.dumps(
            {"metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}
        )
    )


if __name__ == "__main__":
    main()
