"""Assay analytics on Spark: curation, splitting, features, boosted trees, evaluation and scoring."""
