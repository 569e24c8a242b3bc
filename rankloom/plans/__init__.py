"""Whole analyses, from source tables to results."""

from rankloom.plans.experiment import (
    Sources,
    experiment_quicklook,
    experiment_report,
    experiment_report_by_date,
    rank_table,
    store_sorted_ranks,
)
from rankloom.plans.top_queries import popular_rank_table, top_query_report

__all__ = [
    "Sources",
    "experiment_quicklook",
    "experiment_report",
    "experiment_report_by_date",
    "popular_rank_table",
    "rank_table",
    "store_sorted_ranks",
    "top_query_report",
]
