"""Scalar functions: text primitives and the HTML tree builder."""
