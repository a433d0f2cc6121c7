"""Operators for building training data out of large text corpora.

Nothing outside this folder imports it.  Each module holds one operator with a
general interface; :mod:`sessionloom.llm.queries` applies them to the tables.
"""
