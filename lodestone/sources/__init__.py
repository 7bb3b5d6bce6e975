"""Collections from files, and saved indexes."""
