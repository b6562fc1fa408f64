"""sluice: Spark-native detection, triage and corpus-preparation operators."""
