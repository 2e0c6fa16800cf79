"""See the package docstring and README for the layout."""
