"""Data-quality measurement of tables with Spark: profile, score, contract, drift, fix."""

from .operators.analytics import (
    best_correlation_pair, box_plots, column_health, correlation_matrix, dtype_mix, health_radar,
    histogram, issue_mix, issue_summary, null_by_column, null_matrix, penalty_breakdown,
    quality_ranking, row_completeness, scatter_sample, stacked_null, strong_pairs, top_categories,
)
from .operators.contracts import (
    Rule, assess_contract, build_rules, dimension_contributions, dimension_scores,
    empty_cells_per_row, evaluate_rules, profile_registry, resolve_columns, sample_failures,
    weighted_score,
)
from .operators.drift import (
    columns_added_removed, distribution_shifted, drift_summary, ks_statistic, schema_drift,
    type_changed, with_p_value,
)
from .operators.fixes import (
    apply_fixes, fix_dedupe, fix_drop_nulls, fix_impute_median, fix_impute_mode,
    fix_strip_whitespace, suggest_fixes,
)
from .operators.profile import profile_table
from .operators.review import (
    columns_of_interest, evidence_completeness, evidence_envelope, evidence_issue_counts, evidence_samples,
    report_rows, triage_issues, triage_summary,
)
from .operators.rows import column_series, preview, reject_empty, row_sample
from .operators.scoring import (
    column_quality, column_scores, duplicate_rows, effective_score, table_score,
)
from .operators.sketches import (
    approximate_profile, column_sketches, merge_sketches, read_sketches,
)
from .plans.keys import settled
from .sources.readers import (
    dedupe_headers, drop_unnamed_empty, flatten_json, load_table, normalize_cells,
    normalize_table, scan_delimited, scan_json_records, scan_parquet, sniff_delimiter,
)
