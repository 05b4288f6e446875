"""Streaming counterparts: page streams and a request cache with time to live."""
