"""Registered queries: each runs a library operator over whole tables, most with a SQL twin."""
