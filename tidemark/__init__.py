"""Layered data pipelines on Spark: land, conform, check, model, reconcile, report."""
