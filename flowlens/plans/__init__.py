"""Whole plans: dispatch by specification, experiments, the registered queries."""
