"""Readers, writers and the derivation of domain tables."""
