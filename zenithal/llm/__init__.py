"""Operators of a training-data pipeline: ten text and vector operators.

Nothing outside this subpackage imports it.
"""
