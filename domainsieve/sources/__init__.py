"""Readers of landed files and writers of state tables."""
