"""Bindings to tables, the query catalogue and its SQL."""
