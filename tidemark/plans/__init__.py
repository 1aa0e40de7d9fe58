"""Chains of operators that make whole feature tables."""
