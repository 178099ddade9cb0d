"""Operators over tables: profiles, relationships, concept graph, matching, retrieval, evaluation."""
