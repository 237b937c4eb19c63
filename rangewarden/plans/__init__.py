"""Configurations, and the plans and reports made from them."""
