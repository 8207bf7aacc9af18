"""Transforms of columns: facts of the table are fitted first, then projected on to its rows."""
