"""Operators that prepare training data for language models. Nothing else in the package imports this part."""
