"""Writes PLANS.md: the physical plans (after adaptive execution) of the headline queries."""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from filelens import catalog as K  # noqa: E402
from filelens.session import get_session  # noqa: E402

HEADLINE = ["duplicate_summary", "marked_duplicates", "median_size", "directory_sizes", "search_grid",
            "extreme_files", "unsafe_groups", "staging_plan", "duplicate_groups_fast", "subtree_totals"]


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for sides too large to broadcast
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    out = ["# Physical plans of the headline queries", "",
           f"Final adaptive plans at `{sf_dir}` (local, 8 shuffle partitions, broadcast joins off), from `tools/plans.py`.", ""]
    for name in HEADLINE:
        df = K.registry()[name](spark, sf_dir)
        df.collect()  # run once so the adaptive plan is final
        plan = df._jdf.queryExecution().executedPlan().toString()
        final = plan.split("+- == Initial Plan ==")[0].strip()
        out += [f"## {name}", "", "```", final, "```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main()
