"""Scan-metadata harmonisation as Spark DataFrame jobs.

``sources``   reading, consolidating and fingerprinting per-session tables
``functions`` column expressions (coercion, keyword rules, naming, response text)
``operators`` DataFrame -> DataFrame steps (profile, group, conform, map, rules)
``plans``     the steps put together: test-data views, queries and their SQL oracle
"""
