"""Search over unbounded collections."""
