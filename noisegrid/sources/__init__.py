"""Readers and writers of the formats that noise data come in."""
