"""Operators that prepare large text corpora for training: one module each, plus their queries."""
