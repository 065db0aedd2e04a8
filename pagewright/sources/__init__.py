"""Readers and writers of page directories, reports and word lists."""
