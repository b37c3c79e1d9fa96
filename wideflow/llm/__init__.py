"""Operators for training-data pipelines: dedup, quality, tokens, mixing, search.

Nothing else in the library imports this package; it may import the general
helpers of ``wideflow.session``.
"""
