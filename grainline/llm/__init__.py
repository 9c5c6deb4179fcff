"""Operators for large text, page and vector corpora.

Each module holds one operator with a general interface; ``queries`` maps the
``opN_*`` names to thin queries over the input tables. Nothing outside this
subpackage imports it.
"""
