"""Training-data operators on Spark: quality, dedup, leaks, secrets, language, tokens, packing, HTML."""
