"""Scalar functions over columns: text, numbers with units, rectangles and matrices."""
