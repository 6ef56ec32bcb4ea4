"""Column expressions shared by operators and jobs."""
