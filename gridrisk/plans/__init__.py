"""Whole studies over a panel, and the registered queries."""
