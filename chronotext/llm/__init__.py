"""Operators for building training corpora: language, duplicates, quality, tokens, shards.

Nothing else in the library imports this subpackage; it can be removed on its own.
"""
