"""Cadastre: feature building, neighbour search and evaluation for tabular regression on Spark."""
