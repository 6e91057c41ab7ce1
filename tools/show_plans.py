"""Write the physical plans of the headline queries (sf0.1) to PLANS.md, condensed to the
operators that matter for scale: scans (pushed filters, read schema), exchanges, joins,
aggregates, generators, Python evaluation."""

from __future__ import annotations

import io
import os
import re
import sys
from contextlib import redirect_stdout

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

NAMES = ["chunk_recursive", "chunk_semantic", "merge_stores", "merge_dedup_content", "ingest_details",
         "percentile_breakpoints", "html_to_text", "generate_responses"]
KEEP = re.compile(r"Scan|PushedFilters|ReadSchema|Exchange|Join|HashAggregate|Generate|Window|ArrowEval|MapInPandas|"
                  r"BroadcastExchange|TakeOrdered|Sort \(|Union|Arguments: (hashpartitioning|rangepartitioning|RoundRobin|SinglePartition)")


def main():
    from chunkmill.plans.registry import load_all
    from chunkmill.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session("local[8]", "plans", shuffle_partitions=16)
    reg = load_all()
    out = ["# Physical plans of the headline queries", "",
           f"Condensed `explain('formatted')` output at `{sf}` (initial plans; AQE may still coalesce",
           "partitions, split skewed joins or switch a join to broadcast at run time).", ""]
    for name in NAMES:
        df = reg[name].build(spark, sf)
        buf = io.StringIO()
        with redirect_stdout(buf):
            df.explain("formatted")
        lines = [ln for ln in buf.getvalue().splitlines() if KEEP.search(ln) and len(ln) < 400]
        out += [f"## {name} ({reg[name].ids})", "", "```"] + lines[:60] + ["```", ""]
    spark.stop()
    # task balance of the heaviest queries, from the event log (separate session)
    import subprocess

    here = os.path.dirname(os.path.abspath(__file__))
    res = subprocess.run([sys.executable, os.path.join(here, "stage_times.py"), sf, "chunk_recursive", "chunk_semantic",
                          "merge_stores", "merge_dedup_content"], capture_output=True, text=True)
    table = [re.sub(r"  (\$anonfun|save at|parquet at).*$", "", ln) for ln in res.stdout.splitlines() if ln.strip()]
    out += ["## Task balance (event log, local[8])", "",
            "From `tools/stage_times.py`: per stage the number of tasks, the slowest and median task, and the slowest",
            "task's share of the stage. Single-task stages are the one-row-group scans of the driver tables",
            "(spread round-robin right after) and the small offset/aggregate steps.", "", "```"] + table + ["```", ""]
    open(os.path.join(os.path.dirname(here), "PLANS.md"), "w").write("\n".join(out))


if __name__ == "__main__":
    main()
