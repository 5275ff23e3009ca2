"""Column functions: text, rubric JSON and time series."""
