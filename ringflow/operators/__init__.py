"""Operators over edge tables: graphs, cycles, centrality."""
