"""Operators for training-data pipelines: one module per operator, queries in :mod:`retort.llm.queries`."""
