"""Corpus operators for language-model training data.

One module per operator.  Nothing outside this subpackage imports it.
"""
