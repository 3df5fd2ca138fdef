"""Operators for training-data pipelines.

Nothing outside this subpackage imports it.  Each module holds one operator with its general
interface and the thin query that applies it to whole tables; ``registry`` collects the queries.
"""
