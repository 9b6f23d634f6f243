"""Operators for preparing training text: filters, duplicate search, tokens and packing.

Nothing outside this package imports it.
"""
