"""Readers of web archives, text files and URL lists."""
