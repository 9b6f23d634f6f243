"""Composed evaluations, gates and the query catalogue."""
