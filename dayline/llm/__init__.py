"""Operators of a training-data pipeline, one module each.

Nothing outside this package imports it; ``queries.py`` collects the registered queries.
"""
