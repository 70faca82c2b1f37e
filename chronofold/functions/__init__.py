"""Time columns, metrics and native model states as column expressions."""
