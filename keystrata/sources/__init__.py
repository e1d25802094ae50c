"""Stores: files, logs, catalogs, segments."""
