"""Registered queries: each operator run over the given tables, with equivalent SQL where it exists."""
