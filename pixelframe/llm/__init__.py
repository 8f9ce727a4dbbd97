"""Operators for preparing training text, embeddings, pages and conversations at scale."""
