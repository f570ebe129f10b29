"""Operators for preparing training text, each with its query and, where SQL can say it, its SQL."""
