"""siftstone: document retrieval, evaluation and corpus preparation on Spark."""
