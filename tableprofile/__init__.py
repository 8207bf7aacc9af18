"""Profiles of tables of any size, computed by Spark."""

from tableprofile.functions.columns import columns_of
from tableprofile.operators.charts import (
    box_stats,
    bundle_index,
    bundle_points,
    eda_bundle,
    histogram,
    histogram_auto,
    histograms,
    kde,
    missing_bars,
    missingness_map,
    scatter_matrix_points,
    scatter_points,
)
from tableprofile.operators.describe import (
    column_summary,
    describe,
    outlier_summary,
    quartiles_iqr,
    skewness,
)
from tableprofile.operators.frequency import (
    category_counts,
    describe_text,
    frequencies,
    high_cardinality,
    top_values,
    unique_counts,
)
from tableprofile.operators.history import chat_history
from tableprofile.operators.missing import missing_values, most_missing, total_missing
from tableprofile.operators.relations import (
    correlation_heatmap,
    correlation_matrix,
    most_correlated_pair,
    regression_line,
    top_correlations,
)
from tableprofile.operators.roles import (
    categorical_columns,
    column_roles,
    column_types,
    date_parseable_columns,
    numerical_columns,
    overview,
    shape,
    split_roles,
    text_columns,
    time_named_columns,
)
from tableprofile.operators.selection import (
    outlier_rows,
    require_rows,
    sample_rows,
    select_columns,
)
from tableprofile.operators.facts import Facts
from tableprofile.plans.analyze import analyze, profile_rows
from tableprofile.plans.prompts import (
    answer_questions,
    profile_context,
    question_prompts,
    task_prompts,
    valid_responses,
)
from tableprofile.plans.report import (
    correlation_insights,
    distribution_insights,
    feature_ideas,
    feature_insights,
    insights,
    missing_insights,
    preprocessing_suggestions,
)
from tableprofile.sources.csv import read_csv
from tableprofile.sources.tables import load_table, registry
