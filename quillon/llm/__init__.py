"""Operators for preparing language-model training data. Nothing else in quillon imports this package."""
