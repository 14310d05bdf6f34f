"""Spark jobs for spoken-language-understanding data."""
