"""Chunkers.  Window chunkers are column expressions; structural ones are Arrow UDFs.

All take a text column and return an array of chunks; ``explode_chunks`` makes rows of it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate, islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE, OVERLAP, LEAST = 450, 100, 50
# fixed values: where a text may be cut, the coarsest place first
SEPARATORS = ("\n\n", "\n", "。", "！", "？", ". ", "! ", "? ", "；", "; ", "，", ", ")
WHOLE_NOTE = 300
# fixed values: paths of parts without a heading, and of a note that isn't cut
PREFACE, UNNAMED, WHOLE = "(前言)", "(未命名)", "(整篇)"


def windows(text: Column, size: int = SIZE, overlap: int = OVERLAP, strip: bool = True) -> Column:
    """Windows of ``size`` characters, each ``overlap`` characters into the one before; blank ones are left out."""
    step = max(size - overlap, 1)
    count = F.greatest(F.lit(1), F.ceil((F.length(text) - overlap) / F.lit(float(step))).cast("int"))
    pieces = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(text, i * step + 1, F.lit(size)))
    if strip:
        pieces = F.transform(pieces, lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", ""))
    return F.filter(pieces, lambda p: p != "")


def count_windows(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """How many windows ``hard`` cuts a text into, without cutting it."""
    step = float(max(size - overlap, 1))
    return F.when(F.length(text) > 0, F.greatest(F.lit(1), F.ceil((F.length(text) - overlap) / F.lit(step)).cast("int"))).otherwise(F.lit(0))


def fixed(text: Column, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> Column:
    """Windows of a text of at least ``least`` characters; a text that fits is one chunk as it is."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) < least, F.array().cast("array<string>")).when(F.length(text) <= size, F.array(text)).otherwise(windows(text, size, overlap))


def fixed_to_end(text: Column, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> Column:
    """Stripped windows until one reaches the end of the text; a text that fits is one stripped chunk."""
    text = F.coalesce(text, F.lit(""))
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - size) / F.lit(float(max(size - overlap, 1)))).cast("int"))
    pieces = F.transform(F.sequence(F.lit(0), last), lambda i: strip(F.substring(text, i * max(size - overlap, 1) + 1, F.lit(size))))
    return F.when(F.length(text) < least, F.array().cast("array<string>")).when(F.length(text) <= size, F.array(strip(text))).otherwise(F.filter(pieces, lambda p: p != ""))


# fixed values: extensions of images, whose recognised text is mostly short
IMAGES = ("png", "jpg", "jpeg", "bmp", "tiff")


def extracted(text: Column, extension: Column, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> Column:
    """Chunks of what an extractor found: an image's text that is shorter than a window stays whole, all else is cut."""
    whole = F.lower(extension).isin(*IMAGES) & (F.length(text) < size) & (F.length(text) >= least)
    return F.when(whole, F.array(text)).otherwise(fixed(text, size, overlap, least))


def hard(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Windows as they are, whatever the length; an empty text has none."""
    return windows(F.coalesce(text, F.lit("")), size, overlap, strip=False)


def split_by_first_separator(text: str, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """The parts at the first separator that yields more than one non-blank part."""
    for s in separators:
        parts = [p for p in text.split(s) if p.strip()]
        if len(parts) > 1:
            return parts
    return [text]


def _pack(parts: list[str], glue: str, size: int) -> list[str]:
    """Neighbouring parts joined as long as they fit."""
    groups: list[list[str]] = []
    room = 0
    for part in filter(None, map(str.strip, parts)):
        cost = len(part) + len(glue)
        if groups and cost <= room:
            groups[-1].append(part)
            room -= cost
        else:
            groups.append([part])
            room = size - len(part)
    return [glue.join(g) for g in groups]


def recursive_chunks(text: str | None, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> list[str]:
    """Cut at ever finer separators until all pieces fit, then join small neighbours.

    One pass per separator over the list of pieces: a piece that fits stays, one that doesn't
    is cut and packed.  What no separator brings down is cut into windows.
    """
    if not text or len(text) < least:
        return []
    if len(text) <= size:
        return [text]
    pieces = [text]
    for s in SEPARATORS:
        pieces = [q for p in pieces for q in (_pack(p.split(s), s, size) if len(p) > size and s in p else (p,))]
    step = size - overlap
    flat: list[str] = []
    for p in pieces:
        flat += [p] if len(p) <= size else [p[i : i + size] for i in range(0, max(1, len(p) - overlap), step)]
    merged: list[str] = []
    for p in flat:
        if merged and len(merged[-1]) < 0.8 * size:
            merged[-1] = f"{merged[-1]}\n\n{p}"
        else:
            merged.append(p)
    return merged


_HEADING = re.compile(r"(#{1,6})\s+(.*?)\s*")


def sections(text: str) -> list[tuple[str, str]]:
    """``(path, text)`` of a note's parts, cut before its headings of the second and third level.

    A path names the headings of level one and two that hold at the cut; one of level one ends
    what held before, and opens no part.
    """
    lines = text.splitlines()
    heads = [(n, len(m[1]), m[2].strip()) for n, m in enumerate(map(_HEADING.fullmatch, lines)) if m]
    holding = accumulate(heads, lambda at, h: (h[2], "") if h[1] == 1 else (at[0], h[2]) if h[1] == 2 else at, initial=("", ""))
    cuts = [(h[0], "/".join(filter(None, at)) or UNNAMED) for h, at in zip(heads, islice(holding, 1, None), strict=True) if h[1] in (2, 3)]
    ends = [*(n for n, _ in cuts), len(lines)]
    parts = [(path, "\n".join(lines[a:b]).strip()) for (a, path), b in zip([(0, PREFACE), *cuts], ends, strict=True)]
    return [part for part in parts if part[1]]


def note_chunks(text: str | None, size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[str, str]]:
    """``(heading path, chunk)`` of a note's body: whole if short, else windows of its sections."""
    body = (text or "").strip()
    if not body:
        return []
    if len(body) < WHOLE_NOTE:
        return [(WHOLE, body)]
    step, out = max(size - overlap, 1), []
    for path, part in sections(body):
        cut = [part] if len(part) <= size else [part[i : i + size].strip() for i in range(0, max(1, len(part) - size + step), step)]
        out += [(path, c) for c in cut if c]
    return out


def recursive(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: recursive_chunks(t, size, overlap))

    return run(text)


def by_headings(text: Column, size: Column, overlap: Column) -> Column:
    """``array<struct<heading_path, text>>`` with sizes that may differ by row."""

    @F.pandas_udf("array<struct<heading_path: string, text: string>>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series([[{"heading_path": p, "text": c} for p, c in note_chunks(*row)] for row in zip(*rows, strict=True)], dtype=object)

    return run(text, size, overlap)


def explode_chunks(df: DataFrame, chunks: Column, keep: list[str], index: str = "chunk_index", out: str = "chunk") -> DataFrame:
    """One row per chunk, numbered from 0."""
    return df.select(*keep, F.posexplode(chunks).alias(index, out))
