"""Where the sales table comes from and where results go."""
