"""Operators for large text corpora: one module for each, and their queries in ``queries``."""
