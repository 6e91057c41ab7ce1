"""Stage and task times of registered queries from Spark's event log (written to a scratch
folder; no UI or REST endpoint involved). Prints, per stage: tasks, max and median task time,
and the share of the slowest task, which shows whether one task carries the stage.

usage: python tools/stage_times.py [sf_dir] name [name ...]
"""

from __future__ import annotations

import glob
import json
import os
import statistics
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main():
    from chunkmill.plans.registry import load_all
    from chunkmill.session import build_session

    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.1"
    names = [a for a in args if not a.startswith("/")]
    logdir = tempfile.mkdtemp(prefix="chunkmill-events-")
    spark = build_session("local[8]", "stages", shuffle_partitions=16,
                          extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": f"file://{logdir}",
                                 "spark.eventLog.rolling.enabled": "false", "spark.eventLog.compress": "false"})
    reg = load_all()
    from chunkmill.plans.fixtures import STORE_ORDER, chunk_store

    for w in STORE_ORDER:  # stores exist before the measured queries, as in bench.py
        chunk_store(spark, sf, w)
    for name in names:
        spark.sparkContext.setJobGroup(name, name)
        reg[name].build(spark, sf).write.format("noop").mode("overwrite").save()
    spark.stop()
    tasks, stage_group, stage_name = {}, {}, {}
    for path in [p for p in glob.glob(f"{logdir}/**/*", recursive=True) if os.path.isfile(p)]:
        for line in open(path):
            e = json.loads(line)
            ev = e.get("Event")
            if ev == "SparkListenerJobStart":
                g = (e.get("Properties") or {}).get("spark.jobGroup.id")
                for sid in e.get("Stage IDs", []):
                    stage_group[sid] = g
            elif ev == "SparkListenerStageCompleted":
                info = e["Stage Info"]
                stage_name[info["Stage ID"]] = info.get("Stage Name", "")[:60]
            elif ev == "SparkListenerTaskEnd":
                info = e["Task Info"]
                tasks.setdefault(e["Stage ID"], []).append(info["Finish Time"] - info["Launch Time"])
    print(f"{'query':24s} {'stage':>5s} {'tasks':>5s} {'max ms':>7s} {'median':>7s} {'max/sum':>7s}  call site")
    for sid in sorted(tasks):
        g = stage_group.get(sid)
        if g not in names:
            continue
        t = tasks[sid]
        print(f"{g:24s} {sid:5d} {len(t):5d} {max(t):7d} {int(statistics.median(t)):7d} {max(t) / max(1, sum(t)):7.2f}"
              f"  {stage_name.get(sid, '')}")


if __name__ == "__main__":
    main()
