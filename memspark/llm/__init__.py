"""Operators for preparing training text at scale, and the queries that apply them.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
