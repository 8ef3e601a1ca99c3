"""Stacks from tables, the step pipeline and the registered queries."""
