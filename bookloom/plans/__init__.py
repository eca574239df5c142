"""Whole analyses: operators put together, with shared steps staged once."""
