"""Part of binsieve; see the README."""
