"""Composite reports, and the registered queries over the test tables."""
