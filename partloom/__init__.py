"""Parts-catalog analytics on Spark: crawl pages and exports in, a versioned catalog and its queries out."""

__version__ = "0.1.0"
