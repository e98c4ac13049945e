"""Operators for large training corpora.

Nothing outside this subpackage imports it. Each operator is a module with a general
function on DataFrames; the thin ``opN_<name>`` queries in :mod:`rostra.llm.registry`
apply them to whole tables.
"""
