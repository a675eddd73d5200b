"""Operators for preparing training data at scale.

Nothing outside this folder imports it: the rest of the library works with the folder deleted.
"""
