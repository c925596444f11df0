"""Whole plans: the graph object and the registered queries."""
