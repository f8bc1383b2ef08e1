"""Operators for large text-corpus preparation. Nothing outside this subpackage imports it."""
