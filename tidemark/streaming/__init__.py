"""Streams: land a topic, check it on the way, fold it into a curated table."""
