"""Operators for problems of training data; nothing else in the library imports them."""

from corvane.llm import abuse_queries, cooccurrence_queries, leak_queries, linkage_queries, survivor_queries, tokenize_queries, variant_queries, visual_queries

QUERY_MODULES = [variant_queries, linkage_queries, survivor_queries, cooccurrence_queries, visual_queries, tokenize_queries, leak_queries, abuse_queries]
