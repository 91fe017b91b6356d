"""Incremental forms of the merge, cleaning and counting jobs."""
