"""Corpus preparation for the text records of incidents: bulletins, dossiers, provider pages and chip vectors.

Nothing else in the package imports this folder. Operators take the library's own records, mainly *bulletins*
(``incident_id``, ``message``); the ``op*`` queries map the given tables to them and back.
"""
