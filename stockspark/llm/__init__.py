"""Training-data pipeline operators. Nothing outside this folder (and the
top-level ``corpus_pipeline.py``) imports it."""
