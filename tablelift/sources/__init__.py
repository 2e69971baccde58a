"""Readers: files, JDBC tables and the session catalog."""
