"""Whole plans: the stages of a run, and the registered queries."""
