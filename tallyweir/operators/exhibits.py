"""Choosing and checking the documents of a filing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Endings of documents that hold text.
TEXT_ENDINGS = (".htm", ".html", ".txt", ".xml")


def exhibits(documents: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Documents whose type begins with one of ``kinds`` (``all`` or nothing: any
    exhibit); tagging schemas (EX-101) and files without text are left out."""
    kind, name = F.upper(F.trim("doc_type")), F.lower("document")
    wanted = [k.strip().upper() for k in kinds or ["all"]]
    of_kind = kind.startswith("EX-")
    if "ALL" not in wanted:
        of_kind = F.lit(False)
        for k in wanted:
            of_kind = of_kind | kind.startswith(k if k.startswith("EX-") else f"EX-{k}")
    readable = F.lit(False)
    for ending in TEXT_ENDINGS:
        readable = readable | name.endswith(ending)
    return documents.where(of_kind & ~kind.startswith("EX-101") & readable)


def direct_url(url: Column, hosts: list[str]) -> Column:
    """The document behind a link: viewer links are unwrapped; NULL unless it is an
    https link to one of the trusted hosts."""
    inner = F.regexp_extract(url, r"^https://[^/]+/ix(?:viewer)?/?\?doc=(/[^&#]+)", 1)
    base = F.regexp_extract(url, r"^(https://[^/?#]+)", 1)
    plain = F.when(inner != "", F.concat(base, inner)).otherwise(url)
    host = F.lower(F.regexp_extract(plain, r"^https://([^/?#:@]+)(?=[/?#]|$)", 1))
    return F.when(host.isin(*[h.lower() for h in hosts]), plain)


def readable_body(body: Column) -> Column:
    """Whether a fetched body is a document: not empty, not a viewer's shell."""
    low = F.lower(body)
    return F.coalesce((F.trim(body) != "") & ~F.contains(low, F.lit("loadviewer")) & ~F.contains(low, F.lit("ixvframe")), F.lit(False))
