"""Operators for corpora of training text."""
