"""The queries of the text operators, over whole tables and whole texts, and the SQL of those that SQL can express."""

from __future__ import annotations

from colloquy.llm import credentials, mixing, neighbours, packing, pii, split, threads, truncated

QUERIES = {
    "p1_found": split.found,
    "p1_pieces": split.all_pieces,
    "p2_found": pii.found,
    "p2_masked": pii.masked,
    "p3_found": threads.found,
    "p3_conversations": threads.conversations,
    "p6_found": neighbours.found,
    "p6_top5": neighbours.top5,
    "p6_recall": neighbours.recall,
    "p7_found": credentials.found,
    "p7_redacted": credentials.redacted,
    "p8_containers": packing.all_containers,
    "p8_report": packing.report,
    "p9_mixture": mixing.mixture,
    "p9_shares": mixing.shares,
    "p10_found": truncated.found,
    "p10_shares": truncated.shares,
}
SQL: dict[str, str] = {"p1_found": split.FOUND_SQL}
