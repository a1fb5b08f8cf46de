"""Operators for training data: sampling, diversity, splits, ranking, clustering and text.

Nothing outside this folder imports it.
"""
