"""operators of metaloom."""
