"""Times the headline queries and prints one JSON line.

The given tables are single files of one row group each, which is one task
however many cores there are. A copy in several files is made first, outside
the timing, so that every core reads; the queries are the registered ones.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from gleaner.session import build_session
from workload.queries import REGISTRY

HEADLINE = (
    "token_level_eval",
    "similarity_eval",
    "domain_eval",
    "document_pair_scores",
    "grounding",
    "quote_verdicts",
    "stitch",
    "page_fragments",
    "line_rules_finance",
    "html_markdown",
    "full_gold_eval",
    "domain_dashboard",
    "corpus_listing",
    "run_headline",
    "run_compare",
    "latest_extraction",
    "merge_checks",
    "self_check_corr",
    "upsert_metrics",
    "attach_checks",
    "budget_sweep",
    "parse_fetched",
    "upsert_pages",
    "check_records",
)
TABLES = ("pages", "documents", "conversations", "labels", "benchmark")


def in_files(spark, base: str, files: int) -> str:
    """A copy of the tables in ``files`` files each."""
    folder = tempfile.mkdtemp(prefix="bench-tables-")
    for name in TABLES:
        spark.read.parquet(f"{base}/{name}.parquet").repartition(files).write.parquet(f"{folder}/{name}.parquet")
    return folder


def main() -> None:
    base = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.files.openCostInBytes": "64k",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf = os.path.basename(base.rstrip("/")).removeprefix("sf")
    base = in_files(spark, base, 2 * int(cpus))
    # Start-up of the session and the Python workers is not what is measured.
    REGISTRY["html_markdown"](spark, base).write.format("noop").mode("overwrite").save()
    REGISTRY["run_by_domain"](spark, base).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        started = time.monotonic()
        REGISTRY[name](spark, base).write.format("noop").mode("overwrite").save()
        times[name] = round(time.monotonic() - started, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf,
            }
        )
    )


if __name__ == "__main__":
    main()
