"""Registered queries by topic; each module fills one registry."""
