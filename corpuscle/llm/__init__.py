"""Operators for preparing large training corpora: ten operators over text and vectors.

Nothing outside this subpackage imports it; :mod:`corpuscle.llm.queries` registers one query for
each operator.
"""
