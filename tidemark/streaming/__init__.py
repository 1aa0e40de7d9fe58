"""Streaming versions of panel operators."""
