"""Runs of a query, measured, and reports about them."""

from __future__ import annotations

import json
import time

from pyspark.sql import Observation
from pyspark.sql import functions as F

from siltline.plans.engine import Plan


def analyse(plan: Plan) -> dict:
    """Runs the query without keeping its rows: the explanation, the number of rows, and the seconds it took."""
    seen = Observation()
    start = time.perf_counter()
    plan.frame().observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
    return plan.explain() | {"rows": seen.get["rows"], "seconds": round(time.perf_counter() - start, 3)}


def provenance(plan: Plan, **details: object) -> str:
    """What a result came from, as JSON."""
    return json.dumps(plan.explain() | details, ensure_ascii=False, sort_keys=True, default=str)


def report(measured: dict, form: str = "text") -> str:
    """A short report of a run, as text or Markdown."""
    lines = [("Query", measured["query"].replace("\n", " ")), ("Sources", ", ".join(measured["sources"]) or "-"), ("Columns", ", ".join(f"{c['name']} ({c['kind']})" for c in measured["columns"])), ("Rows", measured.get("rows", "-")), ("Seconds", measured.get("seconds", "-"))]
    lines += [("Decision", ", ".join(f"{a}={b}" for a, b in d.items())) for d in measured["decisions"]]
    if form == "markdown":
        return "\n".join(["| | |", "|---|---|", *(f"| {a} | {str(b).replace('|', '&#124;')} |" for a, b in lines)])
    return "\n".join(f"{a}: {b}" for a, b in lines)
