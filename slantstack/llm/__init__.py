"""Operators for large text corpora: one module an operator, their queries in ``queries``.

Nothing else in the library imports this subpackage.
"""
