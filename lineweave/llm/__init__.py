"""Training-data operators: quality, near-duplicates, token files, secrets, mixing, packing, licences, media.

Nothing outside this subpackage imports it.  Every operator takes and returns DataFrames; the thin
``opN_*`` queries over the test tables are in :mod:`lineweave.llm.queries`.
"""
