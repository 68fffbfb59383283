"""Writing tables, metric records, parameters and fitted models."""
