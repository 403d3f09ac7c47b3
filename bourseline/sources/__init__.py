"""Readers of market files and writers of reports."""
