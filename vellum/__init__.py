"""Vellum: document-store analytics expressed as Spark DataFrame programs."""
