"""Query op7: all documents with their personal data replaced by surrogates."""

from gneiss.llm.common import table
from gneiss.llm.pii import with_surrogates


def op7_pii(spark, sf_dir):
    return with_surrogates(table(spark, sf_dir, "documents"), key="gneiss").select("id", "text", "n_entities").withColumnRenamed("id", "doc_id")


QUERIES = {"op7_pii": op7_pii}

#: The collision checks draw again until none is left, which SQL can't say; tests replace entity by entity in Python and check forms and coreference.
ORACLES = {}
