"""Part of foliary; see README.md."""
