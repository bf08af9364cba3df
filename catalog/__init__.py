"""Runnable examples of every operator over the test tables, with equivalent SQL."""
