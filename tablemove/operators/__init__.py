"""Operators: catalog reads, selection, writes, verification, folds."""
