"""Operators for preparing training text.

Nothing outside this package and ``corpus_pipeline`` imports it; every operator
lives in a module of its own and is loaded on first use.
"""
