"""Readers that turn directories and tables into the files relation."""
