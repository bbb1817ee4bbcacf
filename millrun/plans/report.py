"""Physical-plan summary of every registered query (writes PLANS.md).

Each query is run, then read from ``explain("formatted")`` as it ran at last:
scans, shuffles (and their keys), reused exchanges, broadcasts, join strategies,
aggregate kinds, windows, top-N operators, and the filters pushed into each
Parquet scan. Run: ``python -m millrun.plans.report /root/testdata/sf0.01 > PLANS.md``.
"""

from __future__ import annotations

import contextlib
import io
import re
import sys

TREE = [
    ("Parquet scan", r"Scan parquet"),
    ("reused exchange", r"ReusedExchange \("),
    ("shuffle", r"(?<!Broadcast)(?<!Reused)Exchange \("),
    ("broadcast", r"BroadcastExchange \("),
    ("broadcast hash join", r"BroadcastHashJoin"),
    ("sort-merge join", r"SortMergeJoin"),
    ("nested-loop join", r"BroadcastNestedLoopJoin|CartesianProduct"),
    ("hash aggregate", r"(?<!Object)HashAggregate \("),
    ("object hash aggregate", r"ObjectHashAggregate \("),
    ("sort aggregate", r"SortAggregate \("),
    ("sort", r"(?<!Take)Sort \("),
    ("window", r"(?<!Group)Window \("),
    ("window group limit", r"WindowGroupLimit \("),
    ("top-N", r"TakeOrderedAndProject \("),
    ("generate (explode)", r"Generate \("),
    ("union", r"Union \("),
    ("python (pandas)", r"FlatMapGroupsInPandas|ArrowEvalPython|BatchEvalPython"),
]
PARTITIONING = r"Arguments: ((?:hash|range)partitioning\([^)]*\)|SinglePartition)"


def plan_text(df) -> str:
    df.collect()
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def summarize(text: str) -> dict:
    head = text.split("\n\n(1)")[0].split("== Initial Plan ==")[0]   # the operator tree
    out = {}
    for label, pat in TREE:
        n = len(re.findall(pat, head))
        if n:
            out[label] = n
    keys = sorted(set(re.sub(r", \d+\)$", ")", re.sub(r"#\d+L?", "", k))
                      for k in re.findall(PARTITIONING, text)))
    pushed = sorted(set(re.sub(r"#\d+L?", "", p) for p in re.findall(r"PushedFilters: \[([^\]]*)\]", text)
                        if p))
    schemas = sorted(set(re.findall(r"ReadSchema: (struct<[^>]*>)", text)))
    return {"ops": out, "shuffle_keys": keys, "pushed": pushed, "read": schemas}


def main(argv) -> int:
    from millrun.plans.queries import REGISTRY
    from millrun.session import get_session
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = get_session("local[8]", 16)
    print("# Physical plans of the registered queries\n")
    print(f"Generated by `python -m millrun.plans.report {sf_dir}` from `explain(\"formatted\")` "
          "after each query ran (the final adaptive plan; at this size adaptive execution has turned "
          "the sort-merge joins of small sides into broadcast joins). The fixture views derive ticks and timestamps from "
          "the raw `events.ts`, so alarm ticks bounds are not pushed into these scans (look-backs "
          "also bound `events.ts`, which is); on the "
          "stored alarm log (`historian.read_alarm_events`) they are, together with "
          "`event_date` partition pruning.\n")
    for name in sorted(REGISTRY):
        s = summarize(plan_text(REGISTRY[name](spark, sf_dir)))
        ops = ", ".join(f"{k} x{v}" for k, v in s["ops"].items())
        print(f"## {name}\n\n- operators: {ops}")
        if s["shuffle_keys"]:
            print(f"- shuffle keys: {'; '.join(s['shuffle_keys'])}")
        if s["pushed"]:
            print(f"- pushed to Parquet: {'; '.join(s['pushed'])}")
        if s["read"]:
            print(f"- read schemas: {'; '.join(s['read'])}")
        print()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
