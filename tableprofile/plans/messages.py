"""The wording of findings, advice and answers, with named fields."""

MISSING = {
    "found": "Found {n} columns with missing values.",
    "column": "Column '{column}' has {count} missing values ({pct}%).",
    "more": "And {n} more columns have missing values.",
    "drop": "Consider dropping columns with >50% missing values: {columns}.",
    "impute": "Consider using imputation techniques for columns with missing values.",
    "none": "No missing values found in the dataset. Great job!",
}

DISTRIBUTION = {
    "skew": "Column '{column}' is {direction}-skewed (skewness: {skew}). Consider log transformation.",
    "outliers": "Column '{column}' has {count} outliers ({pct}%). Consider outlier treatment.",
    "more": "Additional {n} numerical columns not analyzed here.",
    "none": "No numerical columns found for distribution analysis.",
}

CORRELATION = {
    "found": "Found {n} pairs of highly correlated features.",
    "pair": "'{x}' and '{y}' are strongly {direction} correlated (r={r}).",
    "more": "And {n} more highly correlated pairs found.",
    "advice": "Consider removing some highly correlated features to reduce dimensionality.",
    "none": "No strong correlations found between features.",
    "too_few": "Need at least 2 numerical columns to analyze correlations.",
}

FEATURES = {
    "dates": "Found {n} potential date columns: {columns}.",
    "date_parts": "Consider extracting year, month, day, weekday from these columns.",
    "categories": "Found {n} categorical columns.",
    "encoding": "Consider one-hot encoding or label encoding for categorical features.",
    "high": "Some categorical columns have high cardinality:",
    "high_column": "Column '{column}' has {n} unique values. Consider grouping less common categories.",
    "polynomial": "Consider creating polynomial features or interaction terms between numerical features.",
}

SUGGEST_MISSING = {
    "found": "Found {n} columns with missing values.",
    "many": "Columns with highest missing values: {columns}...",
    "few": "Columns with missing values: {columns}",
    "strategies": [
        "Consider these strategies for handling missing values:",
        "- Imputation (mean/median for numerical, mode for categorical)",
        "- Creating missing value indicators as new features",
        "- Removing rows or columns with too many missing values",
    ],
}

SUGGEST_NUMERICAL = {
    "found": "Found {n} numerical columns.",
    "steps": [
        "Consider these preprocessing steps:",
        "- Scaling (StandardScaler or MinMaxScaler)",
        "- Check for skewness and apply log or Box-Cox transformation if needed",
        "- Create binned versions of continuous variables",
    ],
}

SUGGEST_OUTLIERS = {"column": "Column '{column}' has {count} potential outliers ({pct}%)."}

SUGGEST_CATEGORICAL = {
    "found": "Found {n} categorical columns.",
    "high": "High cardinality columns (many unique values):",
    "high_column": "- {column}: {n} unique values",
    "high_steps": [
        "For high cardinality columns, consider:",
        "- Grouping less frequent categories",
        "- Target encoding or embedding techniques",
    ],
    "encoding": [
        "General categorical encoding strategies:",
        "- One-hot encoding for low cardinality columns",
        "- Label encoding for ordinal variables",
    ],
}

SUGGEST_GENERAL = [
    "General preprocessing recommendations:",
    "- Check for duplicate rows and remove if necessary",
    "- Normalize text fields (lowercase, remove special characters)",
    "- Create feature interactions for highly correlated features",
]

IDEAS_NUMERICAL = [
    "### Numerical Feature Transformations:",
    "1. Create polynomial features for continuous variables",
    "2. Apply mathematical transformations (log, sqrt, square) to handle skewed distributions",
    "3. Create binned versions of continuous features to capture non-linear relationships",
]

IDEAS_TIME = [
    "\n### Time-Based Features:",
    "Detected potential date/time columns: {columns}",
    "1. Extract components like year, month, day, weekday, quarter",
    "2. Create cyclical features using sine/cosine transformations for periodic time components",
    "3. Calculate time since specific events or time differences between dates",
]

IDEAS_CATEGORICAL = [
    "\n### Categorical Feature Engineering:",
    "1. Create interaction features by combining categorical variables",
    "2. Use target encoding for high cardinality categorical features",
    "3. Combine rare categories into an 'Other' category to reduce dimensionality",
]

IDEAS_MIXED = [
    "\n### Feature Interactions:",
    "1. Create group-based statistics (mean, median, min, max) of numerical features grouped by categorical features",
    "2. Calculate the difference from group means for numerical features",
    "3. Create ratio or difference features between related numerical columns",
]

IDEAS_REDUCTION = [
    "\n### Dimensionality Reduction:",
    "1. Apply PCA to reduce dimensionality and create principal components",
    "2. Use feature selection methods (information gain, chi-square, mutual information)",
    "3. Try UMAP or t-SNE for non-linear dimensionality reduction",
]

IDEAS_TEXT = [
    "\n### Text Feature Engineering:",
    "Detected potential text columns: {columns}",
    "1. Create bag-of-words or TF-IDF representations",
    "2. Extract text length, word count, and other statistical features",
    "3. Consider pretrained word embeddings or sentence transformers",
]

CONTEXT = {
    "column": "- {column} ({dtype})",
    "missing": "- {column}: {count} missing values ({pct}%)",
    "no_missing": "No missing values detected.",
    "shape": "{rows} rows, {columns} columns",
    "pair": "{x} and {y}: {r}",
    "no_pairs": "No numerical columns to calculate correlations.",
    "profile_head": "Top correlations:",
    "profile_pair": "{x} -- {y}: {r}",
    "profile_too_few": "Not enough numerical columns for correlation analysis.",
}

# Keywords of each intent; the first intent with a keyword in the question wins.
INTENTS = (
    ("missing", ("missing",)),
    ("pattern", ("pattern",)),
    ("feature", ("feature", "engineering")),
    ("distribution", ("distribut",)),
    ("correlation", ("correlat", "relation")),
    ("prepare", ("prepare", "model")),
)

ANSWERS = {
    "missing": "I found {n} missing values across the dataset. The columns with the most missing values are: {columns}.",
    "pattern": "Looking at the data, I can see several interesting patterns. The numerical features show varied distributions, and there might be some correlations worth exploring further.",
    "feature": "Based on the data, I'd recommend feature engineering steps like handling missing values, encoding categorical variables, and possibly creating interaction terms for highly correlated features.",
    "distribution": "The numerical variables show different distributions. Some appear to be normally distributed while others show skewness. Let me know if you want to see visualizations for specific columns.",
    "correlation": "I detected several strong correlations in the dataset. You might want to look at the correlation heatmap in the Relationships tab for more details.",
    "prepare": "To prepare this data for modeling, I suggest: 1) Handling missing values, 2) Encoding categorical variables, 3) Feature scaling, and 4) Possibly dimensionality reduction if you have many features.",
    "generic": "I analyzed your dataset and found some interesting insights. You can explore different aspects of your data using the tabs above. Is there anything specific you'd like to know about your data?",
    "no_table": "Please upload a dataset first so I can analyze it and answer your questions.",
}

# Shortest accepted response lengths are one above these.
MIN_INSIGHT_CHARS = 50
MIN_CHAT_CHARS = 10
