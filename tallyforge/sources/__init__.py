"""Readers, normalisers, sinks and table maintenance."""
