"""Operators for building large training corpora: dedup, mixing, scoring, tokenising, search."""
