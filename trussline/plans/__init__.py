"""Registered queries: operator chains over the supplied tables, with their SQL."""
