"""Analyses built from the operators."""
