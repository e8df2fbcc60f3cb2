"""Turns corpora of rendered web pages into navigation catalogs and Markdown with Spark."""
