"""Hardware-address registry analytics on Apache Spark.

Registry and enrichment records become validated, hashed tables; many sources
resolve into one conflict-checked release; tables or streams of 48-bit
addresses are enriched with their longest official prefix and ranked claims.
"""

__version__ = "0.1.0"
