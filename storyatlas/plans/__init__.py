"""Whole plans: views, and the registered queries."""
