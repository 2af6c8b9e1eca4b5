"""Readers for report files and task pages."""
