"""See the package docstring of quillspark."""
