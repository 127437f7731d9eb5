"""Whole reports and the monthly run, composed from the operators."""
