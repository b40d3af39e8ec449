"""Logical plans: the modelled tables (view, dims, fact), marts and reports."""
