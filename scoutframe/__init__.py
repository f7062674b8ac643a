"""A PySpark engine for scoring and comparing players from box-score and event data."""
