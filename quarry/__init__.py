"""quarry: Spark-native curation, scoring and comparison jobs for chat-tuning data and model outputs.

Main entry points (each takes and returns DataFrames; nothing is collected):

* curation   ``plans.curate.curate(events, conversations)``, ``plans.chat.tag_records(records)``,
             ``plans.chat.chat_dataset(sources, n_samples, seed)``, ``plans.chat.chat_funnel(sources)``
* scoring    ``plans.score.fact_eval``, ``plans.score.choice_eval``, ``plans.score.grid_scoring``,
             ``operators.aggregates.best_of_k`` / ``accuracy`` / ``choice_rate`` / ``split_summary``
* metrics    ``plans.text_metrics.diversity_per_text``, ``plans.perplexity.ngram_perplexity``,
             ``plans.perplexity.logprob_perplexity``, ``plans.story_eval.story_metrics`` / ``compare_models``
* set-up     ``plans.evalgrid.prompt_constraints``, ``job_grid``, ``coverage``, ``dimension_lookup``
* results    ``plans.results.read_harness_tree``, ``unified_metrics``, ``latest_per_label``,
             ``base_vs_variant``, ``results_by_trait``
* streaming  ``streaming.first_seen.start_first_seen`` / ``read_first_seen``,
             ``streaming.incremental.start_append``
* I/O        ``sources.files`` readers, ``sinks.files`` writers, ``sources.listing`` pages
"""

__version__ = "0.1.0"
