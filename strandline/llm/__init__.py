"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Each module is one operator with a
general interface; ``queries`` holds the thin ``opN_*`` queries.
"""
