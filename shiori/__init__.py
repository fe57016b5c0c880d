"""Shiori: corpus analytics for language learners, expressed as Spark plans."""
