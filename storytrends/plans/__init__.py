"""Whole jobs, the views of the test tables and the registered queries."""
