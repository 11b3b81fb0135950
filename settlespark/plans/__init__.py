"""Registered queries and the SQL that states the same result."""
