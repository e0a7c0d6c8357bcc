"""Importing this module registers every query."""

from clearcase.plans import case_queries, deid_queries, event_queries, flow_queries, letter_queries, ops_queries, proof_queries, store_queries  # noqa: F401
