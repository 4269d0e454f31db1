"""The near-duplicate stage of the pipeline: five-word shingles, a similarity of 0.8 or more, one text of each group.

op2's fingerprints of the five-word shingles and its ball hashing give the near pairs. At 0.8 two fingerprints differ in
about 10 bits, which no ball reaches, so the bands of `bbit` give the rest. Either kind of pair becomes a link by its
whole sets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketgrid.llm import bbit, simhash
from marketgrid.llm.common import stage
from marketgrid.llm.simhash import keep_first

SHINGLE = 5


def fingerprint_pairs(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): pairs of `nodes` (node, text_hash) that connect all whose fingerprints differ in two bits at most.

    Nodes of one fingerprint are paired with the least of them, and these by `simhash.links`, so there are about as
    many pairs as nodes and links, whatever the size of a group.
    """
    prints = simhash.fingerprints(docs, SHINGLE).groupBy("text_hash").agg(F.min("fp").alias("fp"))
    known = stage(nodes.join(prints, "text_hash").select("node", "fp"), "fingerprints")
    lead = stage(known.groupBy("fp").agg(F.min("node").alias("lead")), "fingerprint-leads")
    same = known.join(lead, "fp").filter("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b"))
    return stage(same.unionByName(simhash.links(lead.withColumnRenamed("lead", "node"))), "fingerprint-pairs")


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, component), one row per document row; texts without words are one component."""
    found = bbit.classes(docs, SHINGLE, lambda nodes: fingerprint_pairs(docs, nodes))
    return found.select("doc_id", "text_hash", "component")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without near-duplicates, columns as they are: of each component one row stays.

    It is the row with the smallest doc_id (rows without id come last), then the smallest text hash, then the
    smallest hash of the whole row, so repeated rows leave one. Null texts and texts without words are alike.
    """
    return keep_first(docs, classes(docs))
