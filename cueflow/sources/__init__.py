"""Readers, writers and codecs: subtitle files, JSON payloads, knowledge tables."""
