"""Write PLANS.md: the physical plan of every registered query, summarised.

For each query: the scans (what is read, which filters reach parquet, which
partitions are pruned, which columns are read), the exchanges (shuffles and
broadcasts), joins and aggregates, from ``explain("formatted")``.

    python scripts/plan_report.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrameWriter  # noqa: E402

from tidemark.plans.catalog import QUERIES, prepare  # noqa: E402
from tidemark.plans.monthly_orders import orders_table  # noqa: E402
from tidemark.session import build_session  # noqa: E402

KEEP = ("Scan", "Exchange", "BroadcastExchange", "Join", "HashAggregate", "SortAggregate",
        "TakeOrderedAndProject", "Generate", "Union", "Window", "Sort")


def formatted(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@contextlib.contextmanager
def written_plans():
    """The plans of what is written to parquet meanwhile."""
    plans, parquet = [], DataFrameWriter.parquet

    def recorded(self, path, *args, **kwargs):
        plans.append(formatted(self._df))
        return parquet(self, path, *args, **kwargs)

    DataFrameWriter.parquet = recorded
    try:
        yield plans
    finally:
        DataFrameWriter.parquet = parquet


def summarise(text: str) -> list[str]:
    tree = text.split("\n\n\n", 1)[0]
    out = ["```", *[line for line in tree.splitlines()[1:] if line.strip()], "```"]
    for block in text.split("\n\n"):
        head = block.strip().splitlines()[0] if block.strip() else ""
        if not head.startswith("(") or not any(k in head for k in ("Scan", "Exchange")):
            continue
        details = []
        for line in block.strip().splitlines()[1:]:
            key = line.split(":", 1)[0]
            if key in ("Location", "PushedFilters", "PartitionFilters", "ReadSchema", "Arguments"):
                line = re.sub(r"file:/\S*/tidemark/", "<shared>/", line)
                line = re.sub(r"file:/root/testdata/sf[0-9.]+/", "", line)
                line = re.sub(r"#\d+L?", "", line)
                details.append(f"  - {line.strip()}")
        out.append(f"- {head.strip()}")
        out.extend(details)
    return out


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session()
    lines = [
        "# PLANS",
        "",
        f"Physical plans of the registered queries on `{sf_dir}` (`local[8]`, AQE on), from",
        "`explain(\"formatted\")`, written by `scripts/plan_report.py`. The plan shown is the one",
        "before AQE's runtime re-planning (`isFinalPlan=false`). Where a query writes a table first,",
        "the plan of what is written is shown too. Paths under the shared folder are shortened to `<shared>/`.",
        "",
    ]
    # Tables that the read-only queries share are built before.
    orders_table(spark, sf_dir)
    orders_table(spark, sf_dir, gaps=True)
    prepare(spark, sf_dir)
    for name, fn in QUERIES.items():
        lines.append(f"## {name}")
        lines.append("")
        with written_plans() as plans:
            df = fn(spark, sf_dir)
        for i, plan in enumerate(plans, 1):
            lines += [f"Written first ({i} of {len(plans)}):" if len(plans) > 1 else "Written first:", "", *summarise(plan), ""]
        if plans:
            lines += ["Returned:", ""]
        lines.extend(summarise(formatted(df)))
        lines.append("")
    print("\n".join(lines))


if __name__ == "__main__":
    main()
