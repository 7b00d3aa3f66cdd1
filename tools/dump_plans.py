"""Write the physical plans of the main queries to docs/PLANS.md.

Each query is executed (collect / noop) first so the adaptive plan shown is
the final one, with the runtime decisions AQE took."""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

KEYS = ["reduce_transactions", "has_bought_30", "assemble_features", "lookback_join",
        "product_share", "competition", "auc_roc"]


def main(sf_dir: str = "/root/testdata/sf0.1", out: str = "docs/PLANS.md") -> None:
    from revisit.plans.queries import queries
    from revisit.session import get_session
    spark = get_session("local[8]", 16)
    spark.conf.set("spark.sql.maxMetadataStringLength", "400")
    qs = queries()
    parts = [f"# Physical plans ({sf_dir}, local[8], AQE final plans)\n",
             "Generated by `python tools/dump_plans.py`.\n"]
    for key in KEYS:
        df = qs[key](spark, sf_dir)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().treeString()
        parts.append(f"## {key}\n\n```\n{plan}```\n")
    os.makedirs(os.path.dirname(out), exist_ok=True)
    with open(out, "w") as fh:
        fh.write("\n".join(parts))
    spark.stop()


if __name__ == "__main__":
    main(*sys.argv[1:])
