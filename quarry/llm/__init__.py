"""Training-data pipeline operators (packing, near-duplicates, token files, chat rendering,
decontamination, toxicity, sharding, quality, rules, personal data). Nothing outside this
subpackage, ``corpus_pipeline.py`` and the guarded block of ``__spark_entry__.py`` imports it."""
