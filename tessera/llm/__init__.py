"""Operators for preparing training corpora. Nothing else in tessera imports this package."""
