"""tidemark: time-series events, intervals, features and cohort evaluation as Spark plans."""
