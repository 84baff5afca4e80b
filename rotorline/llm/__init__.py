"""Operators for preparing language-model training data; each module states its method and its edge cases."""
