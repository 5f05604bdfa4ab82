"""Operators of a large-scale training-data pipeline.

Each module holds one operator with its own general interface; ``queries`` derives the thin
registered queries from them.  Nothing outside this subpackage imports it.
"""
