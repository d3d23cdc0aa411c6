"""Part of quillmark; see the package docstring."""
