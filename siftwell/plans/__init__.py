"""Whole plans: pages to pruned Markdown, and the command line."""
