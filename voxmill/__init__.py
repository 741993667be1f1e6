"""A Spark-native engine for speech-localisation data: segments, transcripts, translations, bundles and metrics."""
