"""Operators for large training-data pipelines.

Nothing else in the library imports this package; ``queries()`` and
``oracle_sql()`` in :mod:`provenant.llm.registry` hold its entries.
"""
