"""Importing this module registers every query."""

from . import access_queries, answer_queries, case_queries, directory_queries, draft_queries, evidence_queries, further_queries, graph_queries, learning_queries, ledger_queries, packet_queries, passage_queries, release_queries, retrieval_queries, sequential_queries, source_queries, structure_queries, text_queries  # noqa: F401
from .registry import COVERS, ORACLES, QUERIES

__all__ = ["COVERS", "ORACLES", "QUERIES"]
