"""Operators for training-data pipelines; nothing outside this package imports it.

``queries`` has what the driver entry adds when the package is present.
"""
