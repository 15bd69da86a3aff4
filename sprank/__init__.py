"""sprank: document retrieval on Spark.

Chunking, keyword (BM25) and dense indexes, hybrid top-k search with score
fusion and reranking, prompt assembly and request metrics, all expressed as
DataFrame plans that run on executors.
"""

__version__ = "0.1.0"
