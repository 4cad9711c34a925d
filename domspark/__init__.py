"""HTML parsing and CSS selection over DataFrames of pages."""
