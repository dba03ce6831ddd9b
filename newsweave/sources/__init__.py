"""Readers: configuration, feed, sitemap and page tables into item rows."""
