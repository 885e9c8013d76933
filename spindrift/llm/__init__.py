"""Operators for preparing language-model training data at cluster scale.

Nothing outside this subpackage imports it.  Every module has one operator with
a general interface; ``queries`` registers one thin query per operator.
"""
