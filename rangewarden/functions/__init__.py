"""Scalar functions on columns, and what is rewritten while a plan is made."""
