"""What the driver plans: keys, query languages, and their columns."""
