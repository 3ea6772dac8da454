"""Compliance text analytics on Spark: tag, score, search, measure and report."""
