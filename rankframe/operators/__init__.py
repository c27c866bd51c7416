"""Operators over corpora, queries, judgments and runs."""
