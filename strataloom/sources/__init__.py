"""Tables read from and written to files."""
