"""Filing text as Column expressions: normalising, paragraphs, sentences, figures.

All but the typed figures run inside the JVM, on regular expressions and
higher-order functions.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Typographic characters and their plain forms; the last ones vanish.
_SPACES = "     "
_SINGLE, _DOUBLE, _DASHES = "‘’", "“”", "–—−"
_NOTHING = "​‌‍﻿­"

# Words after whose full stop a sentence goes on.
ABBREVIATIONS = (
    "inc", "ltd", "corp", "co", "llc", "lp", "plc", "pte", "pty", "gmbh", "no", "nos", "mr", "mrs", "ms", "dr", "prof", "sr", "jr",
    "st", "vs", "approx", "dept", "fig", "para", "messrs", "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec",
)

_DOT = "\u0002"  # stands for a full stop that ends no sentence
_LINE = "\n"


def normalised(text: Column) -> Column:
    """Plain spaces, quotes and dashes; zero-width characters gone; runs of white
    space one blank; trimmed."""
    plain = "".join([" " * len(_SPACES), "'" * len(_SINGLE), '"' * len(_DOUBLE), "-" * len(_DASHES)])
    swapped = F.translate(text, _SPACES + _SINGLE + _DOUBLE + _DASHES + _NOTHING, plain)
    return F.trim(F.regexp_replace(swapped, r"(?U)\s+", " "))


def collapsed(text: Column) -> Column:
    """Runs of ASCII white space one blank; trimmed."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0b]+", " "))


def is_furniture(block: Column) -> Column:
    """Page numbers (arabic, roman, with a letter or the word page) and the running
    head of the contents."""
    words = F.trim(F.regexp_replace(F.lower(block), r"[^a-z0-9]+", " "))
    number = F.regexp_replace(F.regexp_replace(words, r"^page | of [0-9]{1,3}$", ""), r"^[a-z]{1,3} ?(?=[0-9])", "")
    roman = (F.length(words) <= 6) & (F.translate(words, "ivxlc", "") == "")
    return (words == "table of contents") | (roman & (words != "")) | ((F.length(number) <= 3) & number.rlike("^[0-9]+$") & (F.length(block) <= 16))


def paragraphs(text: Column) -> Column:
    """Blocks between blank lines, without page furniture; a block that a page
    break cut in two (long, no closing mark, next one in lower case) is rejoined.

    Linear in the text: each block looks at its neighbour, then all are joined
    by a blank or a line end and split again.
    """

    def joined(blocks: Column) -> Column:
        open_ = lambda b: (F.length(b) > 60) & ~F.right(F.regexp_replace(b, "[\"')\\]]+$", ""), F.lit(1)).isin(".", "!", "?", ":", ";")

        def piece(block: Column, i: Column) -> Column:
            goes_on = block.rlike(r"^\p{Ll}") & (i > 0) & open_(F.get(blocks, i - 1))
            return F.concat(F.when(F.coalesce(goes_on, F.lit(False)), F.lit(" ")).otherwise(F.lit(_LINE)), block)

        whole = F.substring(F.array_join(F.transform(blocks, piece), ""), 2, 2**31 - 1)
        return F.when(F.size(blocks) > 0, F.split(whole, _LINE)).otherwise(F.array().cast("array<string>"))

    blocks = F.filter(F.transform(F.split(text, r"\n\s*\n"), normalised), lambda b: (b != "") & ~is_furniture(b))
    return F.flatten(F.transform(F.array(blocks), joined))


def cut_sentences(paragraph: Column) -> Column:
    """A paragraph cut after a closing mark before a capital, digit or currency sign.

    Full stops of abbreviations, initials and dotted letters are hidden first, so
    that no cut falls behind them, and brought back at the end.
    """
    hidden = F.regexp_replace(paragraph, rf"(?<![A-Za-z.])((?i:{'|'.join(ABBREVIATIONS)}))\.", f"$1{_DOT}")
    hidden = F.regexp_replace(hidden, r"(?<![A-Za-z.])([A-Za-z](?:\.[A-Za-z]){1,4}|[A-Z])\.", f"$1{_DOT}")
    cut = F.split(hidden, r"(?<=[.!?][\"')\]]{0,3})\s+(?=[\"'(\[]{0,3}[A-Z0-9$])")
    return F.filter(F.transform(cut, lambda s: F.trim(F.translate(s, _DOT, "."))), lambda s: s != "")


def sentences(text: Column) -> Column:
    """Sentences in document order, paragraph by paragraph."""
    return F.flatten(F.transform(paragraphs(text), cut_sentences))


def clipped(sentence: Column, most: int, at: Column | None = None) -> Column:
    """At most ``most`` characters around the place ``at`` (from 1; the beginning
    where there is none), with each cut end marked."""
    n = F.length(sentence)
    start = F.lit(1) if at is None else F.greatest(F.lit(1), F.least(at - most // 3, n - most + 1))
    part = F.trim(F.substr(sentence, start, F.lit(most)))
    marked = F.concat(F.when(start > 1, F.lit("... ")).otherwise(F.lit("")), part, F.when(start + most - 1 < n, F.lit(" ...")).otherwise(F.lit("")))
    return F.when(n <= most, sentence).otherwise(marked)


def item_numbers(text: Column) -> Column:
    """Distinct item numbers such as 5.02, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b([1-9]\.\d{2})\b"), 1)))


def snippet(text: Column, keyword: str, width: int) -> Column:
    """``width`` characters from a quarter of them before the first hit; NULL without one."""
    at = F.instr(F.lower(text), keyword.lower())
    return F.when(at > 0, F.substr(text, F.greatest(F.lit(1), at - width // 4), F.lit(width)))


def without_tags(html: Column) -> Column:
    """Lossy text of markup: scripts, styles and tables dropped, tags blanked."""
    gone = html
    for tag in ("script", "style", "table"):
        gone = F.regexp_replace(gone, rf"(?is)<{tag}\b.*?</{tag}>", " ")
    return collapsed(F.regexp_replace(gone, r"(?s)<[^>]*>", " "))


# Scale words.
_SCALES = {"thousand": 1e3, "million": 1e6, "billion": 1e9}


def money(text: Column) -> Column:
    """array<struct<text, value>> of dollar amounts, scale words applied."""
    found = F.regexp_extract_all(text, F.lit(r"(\$\s?\d[\d,]*(?:\.\d+)?(?:\s(?:thousand|million|billion))?)"), 1)

    def read(t: Column) -> Column:
        number = F.regexp_replace(F.regexp_extract(t, r"(\d[\d,]*(?:\.\d+)?)", 1), ",", "").try_cast("double")
        scale = F.lit(1.0)
        for word, size in _SCALES.items():
            scale = F.when(t.endswith(word), F.lit(size)).otherwise(scale)
        return F.struct(t.alias("text"), (number * scale).alias("value"))

    return F.transform(found, read)


_NUMBER = re.compile(r"\d[\d,]*(?:\.\d+)?")
_SPAN = 60
# Words that make a count one of shares, or a price one of a single piece.
_SHARES, _PIECES = ("shares", "adss"), ("share", "unit", "ads", "warrant")


def figures_of(text: str | None) -> list[tuple[str, str, float, int, str | None]]:
    """(type, text, value, start, share class) of each figure, in order of place.

    Every number is judged by the words around it. Money is what a dollar sign
    precedes: an exercise price if that is what is spoken of, a price per share if
    "per" and a single piece follow, none if it is a par value. A count of four
    digits or with separators is one of warrants or shares by the words that
    follow (or "warrants to purchase" before it); a number before a percent sign is
    a percentage. No number is two figures.
    """
    out = []
    for m in _NUMBER.finditer(text or ""):
        raw = m[0].rstrip(",")
        end, value = m.start() + len(raw), float(raw.replace(",", ""))
        before, after = text[max(0, m.start() - _SPAN) : m.start()], text[end : end + _SPAN]
        said = after.lower().replace("-", " ").split()
        bare = before.rstrip()
        if bare.endswith("$"):
            lead = bare[:-1].removesuffix("US").removesuffix("S").lower()
            lead = lead[max(lead.rfind("$"), lead.rfind(";")) + 1 :]
            start = m.start() - (len(before) - len(bare)) - 1
            if "par value" in lead[-40:] or "nominal value" in lead[-40:]:
                continue
            if "exercise price" in lead:
                out.append(("exercise_price", text[start:end], value, start, None))
            elif said[:1] == ["per"] and any(w.strip(".,;:)") in _PIECES for w in said[1:6]):
                out.append(("price_per_share", text[start:end], value, start, None))
            else:
                scale = said[0].strip(".,;:)") if said and after[:1] == " " else ""
                times = _SCALES.get(scale, 1.0)
                out.append(("money", text[start : end + (1 + len(scale) if times > 1 else 0)], value * times, start, None))
        elif after.lstrip()[:1] == "%":
            out.append(("percent", raw, value, m.start(), None))
        elif "," in raw or len(raw.split(".")[0]) >= 4:
            words = [w.strip(".,;:()\"") for w in said[:6]]
            ahead = before.lower().replace("(", " ").replace('"', " ").replace(")", " ").split()
            if "warrants" in words[:4] or (ahead[-1:] == ["purchase"] or ahead[-2:] == ["up", "to"] or ahead[-3:] == ["an", "aggregate", "of"]) and "warrants" in ahead[-8:]:
                out.append(("warrants", raw, value, m.start(), None))
            elif any(w in _SHARES for w in words) and not any(w[:1].isdigit() for w in words[: next(i for i, w in enumerate(words) if w in _SHARES)]):
                label = words[words.index("class") + 1].upper() if "class" in words[:-1] else None
                out.append(("shares", raw, value, m.start(), label if label and len(label) == 1 else None))
    return out


def figures(text: Column) -> Column:
    """array<struct<type, text, value, start, share_class>> of typed figures, by an
    Arrow-batched function; texts without a digit never leave the JVM."""

    @F.pandas_udf("array<struct<type:string,text:string,value:double,start:int,share_class:string>>")
    def typed(texts: pd.Series) -> pd.Series:
        return texts.map(figures_of)

    none = F.array().cast("array<struct<type:string,text:string,value:double,start:int,share_class:string>>")
    return F.when(text.rlike("[0-9]"), typed(F.when(text.rlike("[0-9]"), text))).when(text.isNotNull(), none)
