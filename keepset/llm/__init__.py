"""Operators for training data: packing, filters, near duplicates, contamination.

Nothing outside this package imports it; deleting it leaves the rest whole.
"""
