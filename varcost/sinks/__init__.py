"""Writers and table definitions."""
