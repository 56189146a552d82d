"""Readers, landing steps, sinks and table maintenance."""
