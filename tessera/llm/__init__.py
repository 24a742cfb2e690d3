"""Operators for preparing large training corpora.

Nothing outside this package imports it.  ``queries`` registers one query per operator.
"""
