"""Whole jobs and named queries put together from the operators."""
