"""Closed value sets, projections and payload shapes of the corpus."""

from pyspark.sql import types as T

# The closed sets of the data model.
ENTITY_TYPES = ("person", "place", "event", "concept", "work", "organization", "species", "artifact", "other")
ENTITY_STATUSES = ("draft", "verified", "flagged", "published")
CITATION_STATUSES = ("unchecked", "verified", "ambiguous", "not_found")
CLAIM_VERDICTS = ("corroborated", "uncertain", "contradicted")
SEVERITIES = ("low", "medium", "high")
DATE_PRECISIONS = ("year", "decade", "century")

PUBLISHED = "published"
#: The short form in which lists return entities.
STUB = ("id", "slug", "canonical_name", "entity_type", "short_description", "consensus_score")

KEY_DATES = T.ArrayType(T.StructType([T.StructField("year", T.IntegerType()), T.StructField("precision", T.StringType()), T.StructField("label", T.StringType()), T.StructField("kind", T.StringType())]))
NOTES = T.ArrayType(T.StructType([T.StructField("claim", T.StringType()), T.StructField("why", T.StringType()), T.StructField("suggestedFix", T.StringType()), T.StructField("severity", T.StringType())]))
FACTS = T.MapType(T.StringType(), T.StringType())
