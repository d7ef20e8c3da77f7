"""Readers and writers: raw CSV, calendar and tariff JSON, feature and result tables."""
