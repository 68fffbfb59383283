"""Model training, tuning and batched encoding on Spark MLlib."""
