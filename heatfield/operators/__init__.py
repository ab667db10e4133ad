"""DataFrame operators: facet queries, timelines, releases."""
