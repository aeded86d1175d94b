"""Corpus preparation operators for language-model training data.

Each module holds one operator as ``DataFrame -> DataFrame``; ``queries`` binds
them to the test tables.  Nothing outside this subpackage imports it.
"""
