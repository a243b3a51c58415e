"""Operators for preparing large text corpora.

Nothing else in the library imports this subpackage.  Each module holds one operator with a
general interface; ``queries`` binds the operators to the tables of a data folder.
"""
