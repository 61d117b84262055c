"""Docketry: document field extraction on Spark, from token tables to scored records."""
