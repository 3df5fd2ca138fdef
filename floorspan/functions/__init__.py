"""Scalar functions on columns; none needs Python on the workers unless it says so."""
