"""Query op11: all embeddings on the first components of their own covariance.

Eigenvectors have no SQL form; the tests hold the query against numpy.
"""

from gneiss.llm.common import table
from gneiss.llm.whitening import whitened


def op11_embedding_whitening(spark, sf_dir):
    return whitened(table(spark, sf_dir, "embeddings"))


QUERIES = {"op11_embedding_whitening": op11_embedding_whitening}

ORACLES = {}
