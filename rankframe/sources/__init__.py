"""Reading and writing corpora, queries, judgments, runs and vectors."""
