"""Data quality on Spark: profiles, metrics, validation, labels and a record classifier."""
