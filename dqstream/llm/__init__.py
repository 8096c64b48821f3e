"""Operators of a training-data pipeline: classifiers, near-duplicates, packing, token files.

Nothing else in the library imports this folder.
"""
