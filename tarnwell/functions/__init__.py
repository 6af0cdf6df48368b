"""Scalar functions over columns: urls, texts and word analysis."""
