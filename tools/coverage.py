"""Write docs/COVERAGE.md from the registered queries."""

import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from skyledger.workloads import WORKLOADS  # noqa: E402

ORDER = "SFJAWTUPEMRD"
rows: dict[str, list[str]] = {}
for w in WORKLOADS.values():
    for item in w.covers.split():
        rows.setdefault(item, []).append(w.name + ("" if w.sql else " (no SQL)"))
ids = sorted(rows, key=lambda i: (ORDER.index(i[0]), int(i[1:])))
lines = [
    "# Coverage", "", f"{len(WORKLOADS)} registered queries, {sum(bool(w.sql) for w in WORKLOADS.values())} with a SQL twin.", "",
    "| survey id | queries |", "|---|---|", *[f"| {i} | {', '.join(rows[i])} |" for i in ids],
]
with open(os.path.join(ROOT, "docs", "COVERAGE.md"), "w", encoding="utf-8") as out:
    out.write("\n".join(lines) + "\n")
want = {"S": 22, "F": 14, "J": 20, "A": 49, "W": 10, "T": 12, "U": 6, "P": 37, "E": 23, "M": 15, "R": 6}
print("missing:", [f"{p}{n}" for p, top in want.items() for n in range(1, top + 1) if f"{p}{n}" not in rows])
