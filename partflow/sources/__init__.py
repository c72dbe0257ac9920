"""Readers, writers and audits."""
