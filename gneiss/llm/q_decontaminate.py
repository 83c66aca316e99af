"""Query op10: the benchmark items that any document holds."""

from pyspark.sql import functions as F

from gneiss.llm.common import materialise, table
from gneiss.llm.decontaminate import leaks


def op10_decontamination(spark, sf_dir):
    return materialise(leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")), "leaks").withColumnRenamed("id", "doc_id")


QUERIES = {"op10_decontamination": op10_decontamination}

#: SQL can't align within an edit budget anywhere in a text at this size; tests compare with brute force.
ORACLES = {}
