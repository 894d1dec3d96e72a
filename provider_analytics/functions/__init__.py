"""See the package README for the layout."""
