"""Registered queries: wiring from the source tables to the operators."""
