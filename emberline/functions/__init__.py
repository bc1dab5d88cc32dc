"""Subpackage of emberline."""
