"""Operators of a training-data pipeline: documents in, documents or verdicts out.

Nothing else in the package imports this subpackage.
"""
