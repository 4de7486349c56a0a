"""Registered queries, their input views and the same rows in SQL."""
