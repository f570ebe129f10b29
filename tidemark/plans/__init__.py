"""Whole steps: land, curate, build marts, reconcile. Input and output happen here only."""
