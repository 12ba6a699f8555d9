"""functions of metaloom."""
