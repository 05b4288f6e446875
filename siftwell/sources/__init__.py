"""Sources (page tables, URL lists, sitemaps, fetching) and sinks."""
