"""Query op9: the language of all documents, learnt from four fifths of them."""

from pyspark.sql import functions as F

from gneiss.llm.common import materialise, table
from gneiss.llm.langid import LanguageModel, held_out


def op9_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = materialise(LanguageModel.fit(docs.where(~held_out())).predict(docs), "languages")
    return found.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op9_language_id": op9_language_id}

#: Trained vectors have no SQL form; tests measure held-out accuracy.
ORACLES = {}
