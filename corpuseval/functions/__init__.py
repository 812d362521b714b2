"""Column functions: labels, model responses, text keys."""
