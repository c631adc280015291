"""Streaming-JSON analytics on Spark: JSON texts as relations of tokens, nodes and pointer events."""
