"""Operators that prepare document text and names for training corpora; nothing outside this package imports it."""
