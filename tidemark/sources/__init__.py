"""Readers and writers of bars, macro series, universes and labels."""
