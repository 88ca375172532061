"""Training-data operators for language models.

Nothing outside this package (and ``corpus_pipeline.py``) imports it.
"""
