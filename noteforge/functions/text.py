"""Scalar text functions (Column in, Column out; Catalyst expressions unless noted)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Characters after which no full stop is added.
TERMINAL = "。！？!?；;….．"


def filled(c: Column) -> Column:
    """c, with the empty string as null."""
    return F.when(c != "", c)


def document_key(source: Column, split: Column, text_id: Column, item_id: Column, note_id: Column, ordinal: Column) -> Column:
    """`source:split:identity`. Identity is the first of: a filled text_id, a filled item_id, a note_id that is not null (may be empty), the ordinal; empty source or split is `unknown`."""
    identity = F.coalesce(filled(text_id.cast("string")), filled(item_id.cast("string")), note_id.cast("string"), ordinal.cast("string"))
    return F.concat_ws(":", F.coalesce(filled(source), F.lit("unknown")), F.coalesce(filled(split), F.lit("unknown")), identity)


def resolved_text(text: Column, title: Column, content: Column) -> Column:
    """the trimmed text if there is one, even empty; else title and content that are not blank, joined by a space."""
    return F.when(text.isNotNull(), F.trim(text)).otherwise(F.concat_ws(" ", filled(F.trim(title)), filled(F.trim(content))))


def resolved_text_loose(text: Column, title: Column, content: Column) -> Column:
    """the text as it is if filled; else filled title and content joined by a space; else one space."""
    return F.coalesce(filled(text), filled(F.concat_ws(" ", filled(title), filled(content))), F.lit(" "))


def prefixed_uid(source: Column, value: Column) -> Column:
    """`source:id`; null where the source is null or blank (an error row for the caller)."""
    return F.when(F.trim(source) != "", F.concat(source, F.lit(":"), value.cast("string")))


def canonical_dataset(name: Column) -> Column:
    """lower case letters and digits; names that contain a known one become it, in this order."""
    compact = F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]", "")
    known = F.when(compact.contains("muge"), "muge").when(compact.contains("flickr"), "flickr").when(compact.contains("coco"), "coco")
    return F.coalesce(known, filled(compact), F.lit("dataset"))


def namespaced(name: Column, uid: Column) -> Column:
    """`name::uid`."""
    return F.concat(name, F.lit("::"), uid.cast("string"))


def without_controls(text: Column) -> Column:
    """no characters of category C (controls, format, unassigned)."""
    return F.regexp_replace(text, r"\p{C}", "")


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility composition; the one step that has no built-in function (Arrow batches)."""
    return s.map(lambda t: None if t is None else t if t.isascii() else unicodedata.normalize("NFKC", t))


def collapsed(text: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalized(text: Column) -> Column:
    """NFKC, no controls (line breaks and tabs vanish with them), single spaces, trimmed."""
    return collapsed(without_controls(nfkc(text)))


def stripped(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def terminated(text: Column) -> Column:
    """with a full stop unless it is empty or ends with a terminal mark."""
    return F.when((text != "") & ~F.substring(text, -1, 1).isin(*TERMINAL), F.concat(text, F.lit("。"))).otherwise(text)


def restored_segments(text: Column, normalize: bool = True) -> Column:
    """segmented text: runs of two or more spaces become a full-width comma, single ones go, a full stop is added."""
    t = stripped(without_controls(nfkc(text) if normalize else text))
    parts = F.filter(F.transform(F.split(t, r"(?U)\s{2,}"), lambda p: F.regexp_replace(p, r"(?U)\s+", "")), lambda p: p != "")
    return terminated(F.array_join(parts, "，"))


def without_tags(text: Column, normalize: bool = True) -> Column:
    """tokens without a `:TAG` suffix of letters, joined, with a full stop."""
    t = without_controls(nfkc(text) if normalize else text)
    words = F.transform(F.split(t, r"(?U)\s+"), lambda w: F.regexp_replace(w, r":[A-Za-z]+$", ""))
    return terminated(F.array_join(F.filter(words, lambda w: w != ""), ""))


def scene_id(source_id: Column) -> Column:
    """`COCO_train2014_<12 digits>` -> 1<digits>, `val` -> 2<digits>; null for anything else."""
    part = F.regexp_extract(source_id, r"^COCO_(train|val)2014_([0-9]{12})$", 1)
    digits = F.regexp_extract(source_id, r"^COCO_(train|val)2014_([0-9]{12})$", 2)
    return F.when(part != "", F.concat(F.when(part == "train", "1").otherwise("2"), digits).cast("bigint"))


def clean_query(value: Column) -> Column:
    """trimmed; blank is null."""
    return filled(F.trim(value))


def clock(seconds: Column) -> Column:
    """seconds as HH:MM:SS (hours may exceed two digits); negative counts as 0."""
    s = F.greatest(F.floor(seconds), F.lit(0)).cast("bigint")
    return F.concat_ws(":", *[F.when(x < 10, F.lpad(x.cast("string"), 2, "0")).otherwise(x.cast("string")) for x in (F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)])


def digest(text: Column) -> Column:
    """SHA-256 in hex of the UTF-8 bytes."""
    return F.sha2(text, 256)


def from_base64(value: Column) -> Column:
    """bytes of Base64 in either alphabet, with missing padding; null for what is none."""
    t = F.rtrim(F.translate(F.regexp_replace(value, r"\s", ""), "-_", "+/"), F.lit("="))
    padded = F.rpad(t, (F.ceil(F.length(t) / 4) * 4).cast("int"), F.lit("="))
    return F.try_to_binary(padded, F.lit("base64"))


def resolved_path(path: Column, root: str) -> Column:
    """Absolute paths stay, relative ones are joined to root."""
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def rounded(c: Column, places: int = 6) -> Column:
    """floats rounded half up to so many places."""
    return F.round(c, places)
