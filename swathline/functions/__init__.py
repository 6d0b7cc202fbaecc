"""Scalar functions as SQL expressions.

Every function takes SQL expressions (column names, literals) as strings and
returns one. ``F.expr`` makes a column of it, and Catalyst sees ordinary
built-in arithmetic: no function of this package runs Python on rows.
"""
