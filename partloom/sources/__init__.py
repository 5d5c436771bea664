"""Readers and writers: JSON exports, crawled pages, dropdown responses and the stored catalog."""
