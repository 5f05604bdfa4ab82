"""Registered queries: each operator on whole tables, beside its SQL."""
