"""Operators for preparing large text corpora (deduplication, scans, mixing, search).

Nothing outside this folder imports it; ``queries.py`` lists the registered queries.
"""
