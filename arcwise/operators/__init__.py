"""Operators on the graph; each scores all candidates in one plan or one driver loop over plans."""
