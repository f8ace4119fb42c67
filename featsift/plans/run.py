"""Run a chain end to end and write the ``id,label`` CSV (what the reference's
scripts do), e.g.::

    zip -r featsift.zip featsift
    spark-submit --py-files featsift.zip featsift/plans/run.py --tables /data/sf1 --out /shared/sub --chain screen-logreg
    python -m featsift.plans.run --tables /root/testdata/sf0.01 --out /tmp/sub --chain fused-target

The session comes from ``SparkSession.builder.getOrCreate()``, so cluster
settings (master, ``spark.checkpoint.dir``, memory) are whatever the launcher
gives; a local master is used only when none is configured.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

if __package__ in (None, ""):  # run as a script (spark-submit path) from a source checkout
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from featsift.plans import pipelines as PL
from featsift.sources import tables as T
from featsift.sources.sinks import write_submission

CHAINS = ("screen-logreg", "screen-forest", "screen-gbt", "fused-target", "fused-onehot")


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="featsift.plans.run")
    ap.add_argument("--tables", required=True, help="folder with documents/labels/... parquet tables")
    ap.add_argument("--out", required=True, help="output folder for the id,label CSV")
    ap.add_argument("--chain", choices=CHAINS, default="screen-logreg")
    ap.add_argument("--scorer", default="chi2", help="variance | std | anova_f | chi2 (screen-* chains)")
    ap.add_argument("--k", type=int, default=500, help="columns kept by the scorer")
    ap.add_argument("--rounds", type=int, default=100, help="boosting rounds / forest trees")
    ap.add_argument("--depth", type=int, default=6)
    ap.add_argument("--patience", type=int, default=10)
    args = ap.parse_args(argv)

    builder = SparkSession.builder.appName(f"featsift-{args.chain}")
    spark = builder.getOrCreate()
    if args.chain.startswith("screen-"):
        model = {"screen-logreg": "logreg", "screen-forest": "forest", "screen-gbt": "gbt"}[args.chain]
        params = {
            "logreg": {"max_iter": 1000},
            "forest": {"num_trees": args.rounds, "max_depth": args.depth},
            "gbt": {"n_estimators": args.rounds, "max_depth": args.depth, "learning_rate": 0.1},
        }[model]
        cfg = PL.ScreeningConfig(args.scorer, args.k, model=model, model_params=params,
                                 holdout=0.15 if model == "gbt" else None,
                                 patience=args.patience if model == "gbt" else None)
        fitted = PL.fit_screening(T.token_matrix(spark, args.tables, "labelled"), cfg)
        scored = PL.transform_screening(fitted, T.token_matrix(spark, args.tables, "unlabelled", with_columns=False))
        info = {"selected": fitted.width, "best_rounds": fitted.best_rounds}
    else:
        enc = "target" if args.chain == "fused-target" else "onehot"
        scored, _, best = PL.fused_metadata_scores(spark, args.tables, enc, rounds=args.rounds,
                                                   patience=args.patience)
        info = {"best_rounds": best}
    sub = PL.submission_frame(scored)
    write_submission(sub, args.out)
    counts = {int(r["label"]): int(r["n"]) for r in sub.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    print(json.dumps({"chain": args.chain, "out": args.out, "labels": counts, **info}))


if __name__ == "__main__":
    main()
