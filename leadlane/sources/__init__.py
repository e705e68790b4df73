"""Readers: typed file scans, ERP envelopes, extract filters and test-data views."""
