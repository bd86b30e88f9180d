"""Operators of a training-data pipeline: mixing, tokens, language, secrets, fingerprints, quality, scoring, HTML, duplicates.

Common rules. An operator reads the columns it names and no others; extra columns, also such whose names
clash with an output, are left behind unless the docstring says otherwise. Rows come back one for one:
repeated rows and repeated or null ids give repeated rows. An empty table gives an empty table.
"""
