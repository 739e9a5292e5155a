"""Part of the process engine; see README.md."""
