"""Operators for training-data pipelines (search, near copies, tokenizers,
packing, language-model scores, substring copies, toxicity, vectors,
sharding, WARC derivatives).  Nothing else in the library imports this
subpackage."""
