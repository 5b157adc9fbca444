"""Corpus operators for large-scale training data. Nothing else in the package imports this."""
