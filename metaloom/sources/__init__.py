"""sources of metaloom."""
