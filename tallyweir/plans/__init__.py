"""Query catalogue: each module pairs queries with the SQL that checks them."""

#: Modules of this package that register queries.
MODULES = ("pipeline", "facts", "series", "joins", "fiscal", "texts", "discovery", "composites")
