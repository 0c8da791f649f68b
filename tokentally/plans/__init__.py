"""Composite reports and jobs built from the operators."""
