"""Whole pipelines and the registered queries of the core library."""
