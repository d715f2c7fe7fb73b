"""Where edges come from and where results go."""
