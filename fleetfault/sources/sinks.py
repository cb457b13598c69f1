"""Result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_tables(tables: dict[str, DataFrame], path: str, report_dates: DataFrame, mode: str = "append") -> None:
    """Each table as parquet under ``path/<name>``, partitioned by ``report_date``.

    Rows of a date are rebalanced into files of about the advisory size before they are
    written, so small dates are one file and a large report is not one task.  Mode ``replace`` replaces
    the dates that the tables hold and leaves all others: a day that is analysed again has no old rows.
    """
    kept = {"partitionOverwriteMode": "dynamic"} if mode == "replace" else {}
    mode = "overwrite" if mode == "replace" else mode
    for name, table in tables.items():
        if "report_id" in table.columns:
            table = table.join(report_dates, "report_id", "left")
        if "report_date" in table.columns:
            table.hint("rebalance", "report_date").write.mode(mode).options(**kept).partitionBy("report_date").parquet(f"{path}/{name}")
        else:
            table.write.mode(mode).parquet(f"{path}/{name}")


def report_dates(meta: DataFrame) -> DataFrame:
    return meta.select("report_id", F.to_date("report_ts").alias("report_date"))


def result_pages(health: DataFrame, insights: DataFrame, timeline: DataFrame, page_rows: int = 1000) -> DataFrame:
    """The nested JSON result of each report, cut into pages: ``report_id, part, page, result``.

    Pages hold every row and at most ``page_rows`` each, so the largest report
    costs more pages and no larger ones.
    """

    def paged(rows: DataFrame, order: str, part: str) -> DataFrame:
        rest = [c for c in rows.columns if c not in ("report_id", order)]
        packed = F.array_sort(F.collect_list(F.struct(order, *rest)))
        page = F.floor(F.col(order) / page_rows).cast("long")
        return rows.groupBy("report_id", page.alias("page")).agg(F.to_json(packed).alias("result")).select(
            "report_id", F.lit(part).alias("part"), "page", "result"
        )

    scores = F.to_json(F.struct(*[c for c in health.columns if c != "report_id"]))
    head = health.select("report_id", F.lit("health").alias("part"), F.lit(0).cast("long").alias("page"), scores.alias("result"))
    return head.unionByName(paged(insights, "insight_no", "insights")).unionByName(paged(timeline, "seq", "timeline"))
