"""Readers, writers, dataset registry and run history."""
