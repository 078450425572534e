"""Column expressions shared by the checks and the monitor."""
