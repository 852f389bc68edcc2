"""Operators for preparing training text. Nothing else in the library imports this folder.

Rules that hold for all of them: only the named columns are read, so further columns of any
name do no harm; a result has the key columns and the columns the operator documents; a null
text counts as an empty one; repeated rows each get their own result row.
"""
