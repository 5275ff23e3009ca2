"""Readers and writers of items, answers, verdict stores, pasted text and configuration."""
