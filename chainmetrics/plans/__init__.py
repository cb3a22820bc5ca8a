"""The metric tables, one module per subject."""
