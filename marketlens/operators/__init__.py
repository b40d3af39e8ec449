"""Generic DataFrame → DataFrame operators; every report is a composition of these."""

from marketlens.operators.grouping import group_metrics, top_n, semi_top_n, share_of_total, with_empty_bins
from marketlens.operators.ranking import global_row_number, global_ntile, rank_qcut, value_qcut, pareto, abc_classify
from marketlens.operators.stats import (
    value_distribution, histogram, box_stats, corr_matrix, linreg, heatmap, cohort_profile,
    repeatable_sample, growth, funnel,
)

__all__ = [
    "group_metrics", "top_n", "semi_top_n", "share_of_total", "with_empty_bins",
    "global_row_number", "global_ntile", "rank_qcut", "value_qcut", "pareto", "abc_classify",
    "value_distribution", "histogram", "box_stats", "corr_matrix", "linreg", "heatmap",
    "cohort_profile", "repeatable_sample", "growth", "funnel",
]
