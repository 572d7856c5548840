"""Composed plans: the extraction pipeline and the query catalogue."""
