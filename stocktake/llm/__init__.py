"""Operators for preparing training corpora, one module per operator.

Nothing else in :mod:`stocktake` imports this subpackage.
"""
