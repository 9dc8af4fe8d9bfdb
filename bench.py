"""Times the headline queries on the tables in $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
LINES = int(os.environ.get("BENCH_LINES", "500000"))
QUERIES = (
    "mixed_dispatch", "json_lines_parse", "logfmt_parse", "generic_parse", "csv_records", "fold_lines", "effective_ts", "filter_combined",
    "text_search_message", "documents_search", "facet_services", "histogram_filtered", "page_rows", "position_for_time", "flagship",
)


def timed(make) -> float:
    began = time.time()
    df = make()
    if isinstance(df, DataFrame):
        df.write.format("noop").mode("overwrite").save()
    return round(time.time() - began, 3)


def mixed_log(spark: SparkSession, path: str) -> float:
    """A generated log of JSON and framework lines; its size in MB."""
    ms = F.timestamp_millis(F.lit(1_785_031_200_000) + F.col("id") * 15)
    iso = F.date_format(ms, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    service = F.concat(F.lit("svc-"), (F.col("id") % 5).cast("string"))
    level = F.when(F.col("id") % 97 == 0, "warn").otherwise("info")
    json_line = F.format_string('{"time":"%s","level":"%s","service":"%s","msg":"request handled","latency_ms":%d,"request_id":%d}', iso, level, service, F.col("id") % 300, F.col("id"))
    error = F.format_string("%s ERROR %s - upstream failed request_id=%d", iso, service, F.col("id"))
    spark.range(0, LINES, 1, int(CPUS)).select(F.when(F.col("id") % 1009 == 0, error).otherwise(json_line).alias("value")).write.text(path)
    return sum(os.path.getsize(os.path.join(path, f)) for f in os.listdir(path)) / 1e6


def main() -> None:
    from logweir.operators.query import FilterSpec, filter_logs
    from logweir.plans import catalog
    from logweir.session import LogSession

    work = tempfile.mkdtemp(prefix="bench-")
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{work}/shared").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    out: dict[str, float] = {}
    try:
        for name in QUERIES:
            out[name] = timed(lambda n=name: catalog.QUERIES[n](spark, SF_DIR))
        size = mixed_log(spark, f"{work}/mixed")
        session = LogSession(spark, f"file://{work}/logs")
        out["ingest"] = timed(lambda: session.add_file(f"{work}/mixed") and None)
        logs = session.logs().drop("row_id")
        out["warm_level_filter"] = timed(lambda: filter_logs(logs, FilterSpec(levels=frozenset({0}))).agg(F.count(F.lit(1))))
        out["warm_text_search"] = timed(lambda: filter_logs(logs, FilterSpec(query="request_id=1009")).agg(F.count(F.lit(1))))
        total = round(sum(out.values()), 3)
        print(json.dumps({"metric": "log_queries_total", "value": total, "unit": "sec", "queries": out, "sf": SF_DIR, "ingest_mb": round(size, 1), "ingest_mb_per_s": round(size / out["ingest"], 2), "ingest_lines_per_s": round(LINES / out["ingest"])}))
    finally:
        spark.stop()
        shutil.rmtree(work, ignore_errors=True)


if __name__ == "__main__":
    main()
