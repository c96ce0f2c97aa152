"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it; see ``lodestrata.llm.queries`` for
the registered queries and each operator's module for its contract.
"""
