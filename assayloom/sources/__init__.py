"""Reading tables, files, parameters and fitted models."""
