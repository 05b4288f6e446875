"""Operators over pages, nodes, sections, requests and reports."""
