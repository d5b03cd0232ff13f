"""Operators for training-data pipelines over a ``documents`` table.

Nothing outside this subpackage imports it.
"""
