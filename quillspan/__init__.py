"""quillspan: corpus, retrieval and conversation analytics on PySpark."""
