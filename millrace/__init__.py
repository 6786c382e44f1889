"""Spark jobs for code and document corpora: tables in, tables out."""
