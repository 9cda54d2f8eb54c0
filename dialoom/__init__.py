"""dialoom: PySpark-native analytics for annotated dialogue, narrative text and large text corpora."""
