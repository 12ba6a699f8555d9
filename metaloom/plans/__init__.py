"""plans of metaloom."""
