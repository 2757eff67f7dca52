"""Operators for building language-model training data at scale.

Nothing else in the library imports this subpackage; ``registry`` lists its queries.
"""
