"""Readers and writers: truth tables, labels, rule files, recognised words, document plugins, reports."""
