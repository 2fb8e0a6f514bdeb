"""Relational operators of the reconciliation (consolidate, pair, classify, ...)."""
