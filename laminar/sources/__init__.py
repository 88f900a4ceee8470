"""Readers and writers of pages, artifacts, stores and reports."""
