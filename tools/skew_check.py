"""Measure how the ordered-within-a-key operators spread a hot key.

All funnel events of a test folder are put on ONE expert (data derived from
the given tables), the sessions, step analysis and ordering check run on
them, and Spark's event log (written to a fresh scratch folder) gives the
share of shuffled rows read by the busiest task of each stage.  The textbook
window plan puts 100 % in one task; the sliced plans should not.

usage: python tools/skew_check.py [sf_dir]
"""

from __future__ import annotations

import glob
import io
import json
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from funnelkit.operators import quality, steps  # noqa: E402
from funnelkit.operators.sessions import expert_sessions  # noqa: E402
from funnelkit.plans import registry  # noqa: E402
from funnelkit.session import build_session  # noqa: E402


def _task_reads(log_dir: str) -> dict[int, list[int]]:
    import zstandard

    out: dict[int, list[int]] = {}
    for path in sorted(glob.glob(f"{log_dir}/*/events*")):
        raw = open(path, "rb").read()
        try:
            text = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw)).read().decode()
        except Exception:
            text = raw.decode(errors="ignore")
        for line in text.splitlines():
            try:
                e = json.loads(line)
            except ValueError:
                continue
            if e.get("Event") == "SparkListenerTaskEnd":
                tm = e.get("Task Metrics") or {}
                rows = (tm.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0)
                out.setdefault(e["Stage ID"], []).append(rows)
    return out


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    for strategy in ("window", "sliced"):
        log_dir = tempfile.mkdtemp(prefix="funnelkit-skew-")
        spark = build_session("local[8]", 16, **{"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir})
        hot = registry.graph(spark, sf_dir).stg_funnel_events.withColumn("expert_id", F.lit(1).cast("bigint"))
        jobs = [expert_sessions(hot, strategy=strategy)]
        if strategy == "sliced":
            jobs += [steps.funnel_step_analysis(expert_sessions(hot)), quality.timestamp_ordering(hot)]
        for df in jobs:
            df.write.format("noop").mode("overwrite").save()
        spark.stop()
        registry._GRAPHS.clear()
        reads = _task_reads(log_dir)
        big = [(max(r) / sum(r), sum(r)) for r in reads.values() if sum(r) >= 100_000]
        share, total = max(big)
        print(f"{strategy:9s} busiest task reads {100 * share:.0f}% of a stage's {total} shuffled rows")


if __name__ == "__main__":
    main()
