"""docloom: a Spark-native engine for document retrieval data work.

Every operator takes and returns Spark DataFrames. Models (embedder,
reranker, language model, tokenizer) are plug-in functions; the built-in
ones are deterministic stand-ins that make the data flow testable.
"""

__version__ = "0.1.0"
