"""Training-data operators: filtering, deduplication, scoring and mixing of text corpora.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
