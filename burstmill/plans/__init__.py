"""Registered queries and their oracle SQL."""
