"""Storage-format markup of wiki pages to plain text, code kept verbatim."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import decode_entities

_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
_BLOCK = r"</(?:p|div|h[1-6]|li|ul|ol|blockquote|pre|section|article|tr|table)>|<(?:br|hr)\s*/?>"


def _decode(text: str) -> str:
    for entity, char in _ENTITIES:
        text = text.replace(entity, char)
    return text


def to_text(markup: str | None) -> str:
    """Code macros and CDATA verbatim, table rows as ``a | b``, links with their target, blocks as lines."""
    if not markup:
        return ""
    held: list[str] = []

    def hold(code: str) -> str:
        held.append(code)
        return f"\x00{len(held) - 1}\x00"

    macro = r'<ac:structured-macro[^>]*ac:name="(?:code|noformat)"[^>]*>.*?<ac:plain-text-body>\s*<!\[CDATA\[(.*?)\]\]>\s*</ac:plain-text-body>.*?</ac:structured-macro>'
    s = re.sub(macro, lambda m: "\n" + hold(m[1]) + "\n", markup, flags=re.S)
    s = re.sub(r"<!\[CDATA\[(.*?)\]\]>", lambda m: hold(m[1]), s, flags=re.S)

    def row(m: re.Match) -> str:
        cells = re.findall(r"<t[hd][^>]*>(.*?)</t[hd]>", m[1], flags=re.S)
        return " | ".join(re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", c)).strip() for c in cells) + "\n"

    s = re.sub(r"<tr[^>]*>(.*?)</tr>", row, s, flags=re.S)
    s = re.sub(r'<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', lambda m: f"{re.sub(r'<[^>]+>', '', m[2]).strip()} ({m[1]})" if re.sub(r"<[^>]+>", "", m[2]).strip() else m[1], s, flags=re.S)

    def page_link(m: re.Match) -> str:
        body = re.search(r"<ac:(?:plain-text-)?link-body>(.*?)</ac:(?:plain-text-)?link-body>", m[0], flags=re.S)
        title = re.search(r'ri:content-title="([^"]*)"', m[0])
        return body[1] if body else title[1] if title else ""

    s = re.sub(r"<ac:link[^>]*>.*?</ac:link>", page_link, s, flags=re.S)
    s = re.sub(_BLOCK, "\n", s, flags=re.I)
    s = _decode(re.sub(r"<[^>]+>", " ", s))
    s = "\n".join(re.sub(r"[ \t]+", " ", line).strip() for line in s.split("\n"))
    s = re.sub(r"\n{3,}", "\n\n", s).strip()
    return re.sub(r"\x00(\d+)\x00", lambda m: held[int(m[1])], s)


def convert(df: DataFrame, column: str, output: str = "text") -> DataFrame:
    """df with the plain text of a markup column, in Arrow batches."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            yield values.map(to_text)

    return df.withColumn(output, run(F.col(column)))


def strip_tags(markup: Column) -> Column:
    """The part that built-in expressions can do: block ends to newlines, other tags to spaces, entities decoded."""
    s = F.regexp_replace(markup, f"(?i){_BLOCK}", "\n")
    s = decode_entities(F.regexp_replace(s, "<[^>]+>", " "))
    s = F.regexp_replace(F.regexp_replace(s, "[ \t]+", " "), " ?\n ?", "\n")
    return F.trim(F.regexp_replace(s, "\n{3,}", "\n\n"))
