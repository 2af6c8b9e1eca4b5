"""Incremental processing of a drop folder."""
