"""Query op13: all conversations damaged and repaired.

CRC-32 and the least of all cheapest edits have no SQL form here; the tests hold the query against brute force.
"""

from gneiss.llm.common import table
from gneiss.llm.repair import damaged, digests, repaired


def op13_conversation_repair(spark, sf_dir):
    return digests(repaired(damaged(table(spark, sf_dir, "conversations")), "copies"))


QUERIES = {"op13_conversation_repair": op13_conversation_repair}

ORACLES = {}
