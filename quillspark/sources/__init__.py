"""Readers and writers of feeds, drafts and state tables."""
