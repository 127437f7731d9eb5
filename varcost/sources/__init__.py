"""Readers: every frame enters the library through a data contract."""
