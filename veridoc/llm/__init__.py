"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Each module holds one operator that works on any DataFrame with the
columns it names; ``queries`` holds the thin queries over the standard tables.
"""
