"""Readers of index answers, archived pages, live posts, claims and images."""
