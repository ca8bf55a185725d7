"""Operators for preparing large text corpora.

Nothing else in the package imports this subpackage; its queries and their SQL
are in :mod:`tessera.llm.queries`.
"""
