"""Whole jobs made of operators."""
