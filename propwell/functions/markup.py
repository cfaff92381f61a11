"""Element texts of HTML fragments.

Elements are looked up by `data-testid`. A fragment whose wanted elements hold nothing
but text is read by native regular expressions; only the others are handed, Arrow batch
by Arrow batch, to the tolerant parser below. Both ways give the same result.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from html.entities import name2codepoint
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propwell.fixed import IMAGE_GALLERY, LISTING_HREF
from propwell.functions.scalars import stripped

_VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
_SILENT = ("script", "style", "template")
_SELF_CLOSING = ("p", "li", "tr", "td", "option")
_INVISIBLE = (
    r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!doctype[^>]*>"
)
# markup the native way does not read: declarations, raw-text elements, quoted < or >
_NOT_PLAIN = (
    r"(?i)<!|<\?|<(?:script|style|template|textarea|noscript|iframe|xmp)\b"
    r"|=\s*\"[^\"<>]*[<>][^\"]*\"|=\s*'[^'<>]*[<>][^']*'"
)
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
_OTHER_ENTITY = r"&(?!(?:lt|gt|quot|#39|amp);)"


_REFERENCE = re.compile(r"&(?!#)(\w*;?)")
_NAMED = {f"{name};" for name in name2codepoint} | {"apos;"}


def _with_literal_marks(html: str) -> str:
    """A named reference counts only if it is a known one that ends in ';'."""
    return _REFERENCE.sub(
        lambda found: found[0] if found[1] in _NAMED else f"&amp;{found[1]}", html
    )


class _Elements(HTMLParser):
    """Texts of the first element per key, first listing link, gallery images."""

    def __init__(self, keys: Mapping[str, str], by_tag: bool = False):
        super().__init__(convert_charrefs=True)
        self.by_key = {value: name for name, value in keys.items()}
        self.by_tag = by_tag
        self.open: list[tuple[str, str | None, bool]] = []
        self.texts: dict[str, list[str]] = {}
        self.link: str | None = None
        self.images: list[str] = []

    def handle_starttag(self, tag, attrs):
        values = dict(attrs)
        test_id = values.get("data-testid")
        href = values.get("href") or ""
        if self.link is None and tag == "a" and LISTING_HREF in href:
            self.link = href
        if tag == "img" and values.get("src") and any(gallery for _, _, gallery in self.open):
            self.images.append(values["src"])
        name = self.by_key.get(tag if self.by_tag else test_id)
        if name is not None and name in self.texts:
            name = None
        if name is not None:
            self.texts[name] = []
        if tag in _VOID:
            return
        if tag in _SELF_CLOSING and self.open and self.open[-1][0] == tag:
            self.open.pop()
        self.open.append((tag, name, test_id == IMAGE_GALLERY))

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth][0] == tag:
                del self.open[depth:]
                return

    def handle_data(self, data):
        piece = data.strip()
        if piece and not (self.open and self.open[-1][0] in _SILENT):
            for _, name, _ in self.open:
                if name is not None:
                    self.texts[name].append(piece)


def _parsed(html: pd.Series, keys: Mapping[str, str], by_tag: bool = False) -> pd.DataFrame:
    rows = []
    for fragment in html:
        if fragment is None:
            rows.append({})
            continue
        parser = _Elements(keys, by_tag)
        parser.feed(_with_literal_marks(fragment))
        parser.close()
        row = {name: "".join(parser.texts.get(name, [])) for name in keys}
        rows.append({**row, "link": parser.link, "images": parser.images})
    return pd.DataFrame(rows, columns=[*keys, "link", "images"]).astype(object).where(
        lambda frame: frame.notna(), None
    )


def _parser_udf(keys: Mapping[str, str], by_tag: bool = False):
    keys = dict(keys)
    fields = ", ".join(f"{name} STRING" for name in keys)

    @F.pandas_udf(f"{fields}, link STRING, images ARRAY<STRING>")
    def parse(html: pd.Series) -> pd.DataFrame:
        return _parsed(html, keys, by_tag)

    return parse


def _decoded(text: Column) -> Column:
    for entity, character in _ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(character))
    return text


def with_elements(
    df: DataFrame,
    html: str,
    keys: Mapping[str, str],
    into: str = "elements",
    by_tag: bool = False,
    images: bool = False,
) -> DataFrame:
    """Adds a STRUCT of element texts ('' when absent), first listing `link`, gallery `images`.

    `keys` maps result field -> data-testid, or -> tag name with `by_tag`. The native way
    reads a fragment when the wanted elements a loose pattern finds are exactly those a
    strict pattern reads whole. Works in steps, each a column of its own, so that every
    pattern runs once per row.
    """
    wanted = "|".join(keys.values())
    if by_tag:
        strict = rf"<({wanted})(?:\s[^<>]*)?>([^<>]*)</\1\s*>"
        loose = rf"(?i)<({wanted})[\s>/]"
        at_key, at_text = 1, 2
    else:
        strict = (
            rf"<(\w+)\s(?:[^<>]*\s)?data-testid=([\"'])({wanted})\2[^<>]*>([^<>]*)</\1\s*>"
        )
        loose = rf"(?i)data-testid\s*=\s*[\"']?({wanted})[\"'\s>/]"
        at_key, at_text = 3, 4
    anchor = rf"<a\s(?:[^<>]*\s)?href=([\"'])([^\"'<>&]*{LISTING_HREF}[^\"'<>&]*)\1[^<>]*>"
    visible = F.col("_visible")
    found = df.withColumn("_visible", F.regexp_replace(html, _INVISIBLE, "")).withColumns(
        {
            "_seen": F.regexp_extract_all(visible, F.lit(loose), 1),
            "_keys": F.regexp_extract_all(visible, F.lit(strict), at_key),
            "_texts": F.regexp_extract_all(visible, F.lit(strict), at_text),
            "_anchor": F.when(
                visible.contains(LISTING_HREF), F.regexp_extract(visible, anchor, 0)
            ).otherwise(""),
        }
    )
    # the first link is the anchor read only if nothing before it mentions a listing
    first_link = F.position(F.col("_anchor"), visible)
    first_mention = F.position(F.lit(LISTING_HREF), visible)
    simple = (
        ~visible.rlike(_NOT_PLAIN)
        & (F.col("_seen") == F.col("_keys"))
        & ~F.array_join("_texts", " ").rlike(_OTHER_ENTITY)
        & ((first_mention == 0) | ((F.col("_anchor") != "") & (first_link < first_mention)))
    )
    if images:
        simple = simple & ~visible.contains(IMAGE_GALLERY)
    judged = found.withColumn("_simple", F.coalesce(simple, F.lit(True)))
    parsed = judged.withColumn(
        "_parsed", _parser_udf(keys, by_tag)(F.when(~F.col("_simple"), F.col(html)))
    )

    def native(name: str, key: str) -> Column:
        text = F.get("_texts", F.array_position("_keys", key) - 1)
        return F.coalesce(_decoded(stripped(text)), F.lit("")).alias(name)

    href = F.nullif(F.regexp_extract("_anchor", anchor, 2), F.lit(""))
    read = F.struct(
        *[native(name, key) for name, key in keys.items()],
        href.alias("link"),
        F.array().cast("array<string>").alias("images"),
    )
    chosen = F.when(F.col("_simple"), read).otherwise(F.col("_parsed"))
    return parsed.select(*df.columns, chosen.alias(into))


def element_text(df: DataFrame, html: str, *tags: str) -> DataFrame:
    """Adds `elements`, the texts of the first element of each tag ('' when absent)."""
    return with_elements(df, html, {tag: tag for tag in tags}, by_tag=True)
