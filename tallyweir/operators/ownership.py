"""Holdings and insider transactions: roll-ups, and the documents they come from."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed value: a filing whose stated total is below this states thousands.
THOUSANDS_BELOW = 10**10

# Transaction codes of ownership forms and what they mean.
TRANSACTION_CODES = {
    "P": "open-market purchase", "S": "open-market sale", "A": "grant or award", "D": "disposition to issuer", "F": "tax withholding",
    "M": "option exercise", "G": "gift", "C": "conversion", "I": "discretionary", "J": "other", "X": "in-the-money exercise",
}


def in_dollars(holdings: DataFrame) -> DataFrame:
    """``value`` in dollars: filings whose total is below the bound state thousands.

    The total is aggregated and joined back, so a filing of any size is fine.
    """
    totals = holdings.groupBy("accession").agg((F.sum(F.col("value").cast("decimal(38,2)")) < THOUSANDS_BELOW).alias("in_thousands"))
    value = F.when(F.col("in_thousands"), F.col("value") * 1000).otherwise(F.col("value"))
    return holdings.join(totals, "accession").withColumn("value", value)


def concentration(holdings: DataFrame, top: int) -> DataFrame:
    """Per filer: total value, positions, value of the ``top`` largest, and their share."""
    per = holdings.groupBy("filer", "cusip").agg(F.sum(F.col("value").cast("decimal(38,2)")).alias("value"))
    totals = per.groupBy("filer").agg(F.sum("value").cast("double").alias("total"), F.count(F.lit(1)).alias("positions"))
    order = W.partitionBy("filer").orderBy(F.desc("value"), "cusip")
    # Each task's rows are cut to the limit before the shuffle.
    largest = per.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= top).groupBy("filer").agg(F.sum("value").cast("double").alias("top_value"))
    return totals.join(largest, "filer").withColumn("concentration", F.try_divide("top_value", "total"))


def holders(holdings: DataFrame) -> DataFrame:
    """Per security: holders, shares and value, split by kind of position."""
    dec = lambda c: F.col(c).cast("decimal(38,2)")
    kinds = [F.sum(F.when(F.col("put_call") == k, dec("value"))).cast("double").alias(f"{k}_value") for k in ("call", "put", "share")]
    return holdings.groupBy("cusip").agg(F.count_distinct("filer").alias("filers"), F.sum(dec("shares")).cast("double").alias("shares"), *kinds)


def filer_rollup(holdings: DataFrame) -> DataFrame:
    """Per filer: positions, securities, shares and value, split by kind of position."""
    dec = lambda c: F.col(c).cast("decimal(38,2)")
    kinds = [F.sum(F.when(F.col("put_call") == k, dec("value"))).cast("double").alias(f"{k}_value") for k in ("call", "put", "share")]
    per = holdings.groupBy("filer", "cusip").agg(F.count(F.lit(1)).alias("n"), *[F.sum(dec(c)).alias(c) for c in ("shares", "value")])
    totals = per.groupBy("filer").agg(F.sum("n").alias("positions"), F.count(F.lit(1)).alias("securities"), F.sum("shares").cast("double").alias("shares"), F.sum("value").cast("double").alias("value"))
    return totals.join(holdings.groupBy("filer").agg(*kinds), "filer")


def insider_rollup(transactions: DataFrame) -> DataFrame:
    """Per owner and code, and per owner over all codes (code NULL): number, value
    acquired and disposed, net."""
    side = lambda d: F.sum(F.when(F.col("direction") == d, F.coalesce("value", F.lit(0.0)).cast("decimal(38,4)")).otherwise(F.lit(0).cast("decimal(38,4)")))
    rolled = transactions.rollup("owner", "code").agg(F.count(F.lit(1)).alias("n"), side("A").cast("double").alias("acquired"), side("D").cast("double").alias("disposed"), F.grouping_id().alias("level"))
    return rolled.where("level < 3").withColumn("net", F.col("acquired") - F.col("disposed"))


def latest_per(rows: DataFrame, keys: tuple[str, ...], *order: str) -> DataFrame:
    """The last row of each key in the given order."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def latest_with_ties(rows: DataFrame, keys: tuple[str, ...], by: str) -> DataFrame:
    """All rows of each key that share the latest value of ``by``, each once.

    The latest is aggregated and joined back; a key with very many rows is split
    by the skew join, which a ranking window could not do.
    """
    last = rows.groupBy(*keys).agg(F.max(by).alias(by))
    return rows.join(last, [*keys, by], "left_semi").distinct()


# --- documents ---------------------------------------------------------------

OWNERSHIP = (
    "doc_id bigint, form string, issuer_cik string, issuer_name string, owner_cik string, owner_name string, is_derivative boolean, "
    "security string, transaction_date string, code string, shares double, price double, value double, direction string, shares_after double"
)
INFO_TABLE = "doc_id bigint, issuer string, title string, cusip string, value double, shares double, shares_type string, put_call string, discretion string, sole double, shared double, none double"


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _find(node, *path: str):
    for name in path:
        node = next((c for c in node if _local(c.tag) == name), None) if node is not None else None
    return node


def _text(node, *path: str) -> str | None:
    found = _find(node, *path)
    if found is None:
        return None
    inner = _find(found, "value")
    text = (inner if inner is not None else found).text
    return text.strip() or None if text else None


def _number(text: str | None) -> float | None:
    try:
        return float(text.replace(",", "")) if text else None
    except ValueError:
        return None


def _tree(xml: str | None):
    try:
        return ET.fromstring(xml.strip()) if xml else None
    except ET.ParseError:
        return None


def ownership_rows(xml: str | None) -> Iterator[tuple]:
    """Transactions and holdings of one ownership document (Forms 3, 4, 5), in any
    namespace; nothing for text that is no such document."""
    root = _tree(xml)
    if root is None or _local(root.tag) != "ownershipDocument":
        return
    head = [_text(root, "documentType"), _text(root, "issuer", "issuerCik"), _text(root, "issuer", "issuerName")]
    owners = [(_text(o, "reportingOwnerId", "rptOwnerCik"), _text(o, "reportingOwnerId", "rptOwnerName")) for o in root if _local(o.tag) == "reportingOwner"] or [(None, None)]
    for table, derivative in (("nonDerivativeTable", False), ("derivativeTable", True)):
        for line in _find(root, table) or ():
            shares = _number(_text(line, "transactionAmounts", "transactionShares"))
            price = _number(_text(line, "transactionAmounts", "transactionPricePerShare"))
            value = shares * price if shares is not None and price is not None else None
            flag = _text(line, "transactionAmounts", "transactionAcquiredDisposedCode")
            after = _number(_text(line, "postTransactionAmounts", "sharesOwnedFollowingTransaction"))
            for owner in owners:
                yield (*head, *owner, derivative, _text(line, "securityTitle"), _text(line, "transactionDate"), _text(line, "transactionCoding", "transactionCode"), shares, price, value, flag, after)


def info_rows(xml: str | None) -> Iterator[tuple]:
    """Positions of one information table, in any namespace."""
    root = _tree(xml)
    for line in root.iter() if root is not None else ():
        if _local(line.tag) == "infoTable":
            amount, votes = _find(line, "shrsOrPrnAmt"), _find(line, "votingAuthority")
            yield (
                _text(line, "nameOfIssuer"), _text(line, "titleOfClass"), _text(line, "cusip"), _number(_text(line, "value")), _number(_text(amount, "sshPrnamt") if amount is not None else None),
                _text(amount, "sshPrnamtType") if amount is not None else None, (_text(line, "putCall") or "share").lower(), _text(line, "investmentDiscretion"),
                *[_number(_text(votes, n)) if votes is not None else None for n in ("Sole", "Shared", "None")],
            )


def parsed(documents: DataFrame, rows_of, schema: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of documents by a parser above, in Arrow batches; other columns are not read."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames):
        for frame in frames:
            rows = [(key, *row) for key, body in zip(frame[doc_id], frame[text], strict=True) for row in rows_of(body)]
            yield pd.DataFrame(rows, columns=names)

    return documents.select(doc_id, text).mapInPandas(run, schema)


OWNERS = "doc_id bigint, owner_name string, owner_cik string, shares double, percent double, security string, reported string, method string"
# The labels of legacy covers.
PERSON, OWNED, SHARE = "reporting person", "aggregate amount beneficially owned", "percent"
# Element names of the two cover dialects (person, amount, percent, day).
_COVERS = {
    "reportingPersonInfo": ("aggregateAmountOwned", "percentOfClass", "dateOfEvent"),
    "coverPageHeaderReportingPersonDetails": ("reportingPersonBeneficiallyOwnedAggregateNumberOfShares", "classPercent", "eventDateRequiresFilingThisStatement"),
}


def _anywhere(node, name: str) -> str | None:
    return next(((e.text or "").strip() or None for e in node.iter() if _local(e.tag) == name), None)


def _amount(text: str | None) -> float | None:
    """The number a cell holds beside a percent sign and remarks in brackets, if it holds nothing else."""
    plain, depth = "", 0
    for c in text or "":
        depth += (c == "(") - (c == ")" and depth > 0)
        plain += c if not depth and c not in "),% \t\n\r" else ""
    return float(plain) if plain.replace(".", "", 1).isdigit() and plain.isascii() else None


def _behind(line: str, start: int) -> str:
    """What stands on a line behind a label and its remarks ("by each ...", "(9)")."""
    rest, depth = line[start:], 0
    for i, c in enumerate(rest):
        depth += (c == "(") - (c == ")" and depth > 0)
        if not depth and (c == ":" or c.isdigit()):
            return rest[i:].strip(" :-")
    return ""


def _labelled(lines: list[str], label: str) -> str | None:
    """What stands behind a label on its line, or on the next line if nothing does."""
    for line, after in zip(lines, [*lines[1:], ""], strict=False):
        at = line.lower().find(label)
        if at >= 0:
            return _behind(line, at + len(label)) or after
    return None


def _persons(content: str) -> Iterator[list[str]]:
    """The lines of each legacy cover block: behind a line that asks for the name of
    reporting persons, up to the next one."""
    block: list[str] | None = None
    for raw in content.splitlines():
        low = raw.lower()
        at = low.find(PERSON)
        if at >= 0 and "name" in low[:at] and OWNED not in low:
            if block is not None:
                yield block
            rest = raw[at + len(PERSON) :].lstrip("sS")
            if rest.lstrip().startswith("("):
                rest = rest[rest.find(")") + 1 :] if ")" in rest else ""
            block = [rest]
        elif block is not None:
            block.append(raw)
    if block is not None:
        yield block


def owner_rows(content: str | None) -> Iterator[tuple]:
    """Owners on a beneficial-ownership cover: from its elements, else from labelled
    lines of its text. A label whose value is lost gives no owner."""
    root = _tree(content)
    found = False
    for person in root.iter() if root is not None else ():
        fields = _COVERS.get(_local(person.tag))
        name = _anywhere(person, "reportingPersonName") if fields else None
        if name:
            found = True
            amount, percent, day = fields
            yield name, _anywhere(person, "reportingPersonCIK"), _amount(_anywhere(person, amount)), _amount(_anywhere(person, percent)), _anywhere(root, "securitiesClassTitle"), _anywhere(root, day), "elements"
    if found or not content:
        return
    for block in _persons(content):
        lines = [x.strip(" \t:-") for x in block if x.strip(" \t:-")]
        shares, share = _amount(_labelled(lines, OWNED)), _labelled(lines, SHARE)
        if lines and shares is not None and not lines[0].rstrip(".").isdigit():
            yield lines[0], None, shares, _amount(share) if share and "%" in share else None, None, None, "labels"
