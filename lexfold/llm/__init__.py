"""Operators for preparing large text corpora for language-model training.

Nothing outside this subpackage imports it.  Every module holds one operator
with its own general interface; ``queries`` derives the digest columns of the
registered queries from what the operators return.
"""
