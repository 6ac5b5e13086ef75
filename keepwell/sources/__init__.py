"""Inputs and outputs: tables, files, derived record sets, published runs."""
