"""Operators for large-scale training-data preparation.

Nothing else in the library imports this subpackage; `queries` and `oracles`
of `millrace.llm.registry` are what `__spark_entry__` adds when it is present.
"""
