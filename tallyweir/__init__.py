"""tallyweir: set-oriented analytics over regulatory filings, planned by Catalyst.

Every operator takes and returns DataFrames over all filers at once. The
subpackage ``llm`` (training-data operators) is optional: nothing outside it
imports it.
"""
