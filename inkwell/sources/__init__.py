"""Readers for corpora, probe tables and reports."""
