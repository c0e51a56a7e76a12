"""noisesift: Spark-native curation, reweighting and contrastive scoring of augmented text.

Every public operator takes and returns DataFrames (usable with ``df.transform``)
or Columns. Sub-packages:

* ``sources``   -- readers / writers (A)
* ``operators`` -- shaping, filters, joins, sampling, runs, weights, contrast (B-E, H-J)
* ``functions`` -- Column -> Column text / vector helpers and metrics (F, G)
* ``plans``     -- registered queries and their SQL oracles
* ``streaming`` -- keyed contrastive bank in Structured Streaming (K)
"""

from noisesift.session import get_spark, scratch_dir, table  # noqa: F401
