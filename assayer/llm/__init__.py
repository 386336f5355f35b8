"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage; its queries are added to
the entry module only when it can be imported.
"""
