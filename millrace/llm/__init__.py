"""Training-data operators: one module per operator, registered in :mod:`millrace.llm.queries`.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
