"""millrace: curation of continued-pretraining corpora on Spark DataFrames.

Text tables become token blocks, blocks get reference losses, candidate pools
are scored and selected, and selections can be replayed as a curriculum.
"""
