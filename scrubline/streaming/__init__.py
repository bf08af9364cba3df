"""Cleaning rows as they arrive, with decisions taken beforehand on a batch."""
