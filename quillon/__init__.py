"""Sharded document search and its data plumbing as Spark queries."""
