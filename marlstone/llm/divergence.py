r"""An audit of how the vocabularies of a language's sources differ.

Terms are runs of letters, ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+`` with A-Z lower-cased.  A language
keeps the terms that at least ``support`` of its documents hold; V is their number.  A group,
one source of a language, gives a kept term the probability ``p = 1 + floor(10^9 * (count + 5)
/ (N + 5 * V))`` in billionths, N being its occurrences of kept terms; so does the language as
a whole.  Part ``pair`` has the summed differences of p between every two sources of a
language, part ``term`` the terms that a group uses more than its language, the best 50.

Pairs are compared by bitmaps at the level of counts.  A language's kept terms are dealt into
blocks of some hundred; in a block every group stores one bitset of term places for each count
that occurs there.  AND and popcount of two groups' bitsets give the number of terms with
those two counts, a joint cell, which weighs the difference of the two probabilities.  Cells
with a zero are the complement: a level's own popcount less what its cells have shared.

Texts are counted task by task, so that a frequent term or a hot source is one row for each
task.  Bitmaps meet in tasks of one block and two tiles of at most some dozen sources; each of
a language's pairs is in the result, so the tiles are as many as the result needs.

Null text, lang and source count as ''.  Repeated rows are documents of their own.  Groups
without terms have p from count 0; a language without kept terms gives pairs of value 0 and no
terms.  Ties rank by UTF-8.  An empty table gives no rows.  Columns beyond the three are left out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SUPPORT, TOP, BILLION = 30, 50, 1_000_000_000
BLOCK_TERMS, TILE_SOURCES = 512, 32
_HELD = 400_000  # terms that a task counts before it passes them on
_AND_WORDS = 1 << 21  # words of 64 bits that are compared at once
# every byte that isn't part of a term becomes a blank, A-Z become a-z, bytes of other characters stay
_TO_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_TERMS).split()


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Occurrences and documents of terms by group, for the task's documents; a group's own row has no term."""
    groups: dict[tuple[str, str], dict[bytes, list[int]]] = {}
    told: set[tuple[str, str]] = set()
    held = 0

    def flush() -> pd.DataFrame:
        out = [(lang, source, t.decode("utf-8", "surrogatepass"), n, docs) for (lang, source), found in groups.items() for t, (n, docs) in found.items()]
        out += [(lang, source, None, 0, 0) for lang, source in groups.keys() - told]
        told.update(groups)
        groups.clear()
        return pd.DataFrame(out, columns=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for text, lang, source in zip(batch["text"], batch["lang"], batch["source"], strict=True):
            found = groups.setdefault((lang, source), {})
            before = len(found)
            for t, n in Counter(terms(text)).items():
                at = found.get(t)
                if at is None:
                    found[t] = [n, 1]
                else:
                    at[0] += n
                    at[1] += 1
            held += len(found) - before
            if held > _HELD:
                yield flush()
                held = 0
    yield flush()


def count_terms(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``lang, source, term, n, docs``; one row without a term for every group that occurs."""
    texts = df.select(F.col(text).alias("text"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"))])
    found = texts.mapInPandas(_counted, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n, whole, kept):
    """The probability in billionths of a term with ``n`` of ``whole`` occurrences, exact in whole numbers."""
    wide = lambda c, digits: c.cast(f"decimal({digits},0)")
    above, below = wide(F.lit(BILLION), 10) * wide(n + 5, 20), wide(whole + 5 * kept, 20)
    return 1 + F.call_function("div", above, below)


def level_bits(counts: np.ndarray, places: np.ndarray, terms: int) -> tuple[np.ndarray, list[bytes]]:
    """The counts that occur among a block's terms, ascending, and for each the bitset of its places."""
    levels, level = np.unique(counts, return_inverse=True)
    bits = np.zeros((levels.size, 8 * max(1, -(-terms // 64))), np.uint8)
    np.bitwise_or.at(bits, (level, places // 8), (1 << (places % 8)).astype(np.uint8))
    return levels, [b.tobytes() for b in bits]


def _levels(held: pd.Series, terms: pd.Series) -> pd.DataFrame:
    """The levels of one group in one block, from its terms' packed counts and places."""
    out = []
    for packed, size in zip(held, terms, strict=True):
        packed = np.asarray(packed, np.int64).reshape(-1, 2)
        out.append(level_bits(packed[:, 0], packed[:, 1], int(size)))
    return pd.DataFrame(out, columns=["counts", "bits"])


def joint_cells(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many places two stacks of bitsets (words of 64 bits) share, level by level."""
    cells = np.zeros((len(a), len(b)), np.int64)
    step = max(1, _AND_WORDS // max(1, b.size))
    for i in range(0, len(a), step):
        cells[i : i + step] = np.bitwise_count(a[i : i + step, None, :] & b[None, :, :]).sum(2, dtype=np.int64)
    return cells


class _Group:
    """A group's bitsets of one block, its probabilities by level (0 first), and its levels' sizes."""

    def __init__(self, row):
        counts, self.source = [int(c) for c in row.counts], row.source
        self.bits = np.frombuffer(b"".join(row.bits), np.uint64).reshape(len(counts), -1) if counts else np.zeros((0, 1), np.uint64)
        below = max(1, int(row.whole) + 5 * int(row.kept))  # 0 only where the language keeps no term
        self.p = np.array([1 + BILLION * (c + 5) // below for c in [0, *counts]], np.int64)
        self.sizes = np.bitwise_count(self.bits).sum(1, dtype=np.int64)


def difference(a: _Group, b: _Group, size: int) -> int:
    """Summed differences of probability over a block of ``size`` terms."""
    cells = np.zeros((len(a.p), len(b.p)), np.int64)
    if len(a.p) > 1 and len(b.p) > 1:
        cells[1:, 1:] = joint_cells(a.bits, b.bits)
    cells[0, 1:] = b.sizes - cells[1:, 1:].sum(0)
    cells[1:, 0] = a.sizes - cells[1:, 1:].sum(1)
    cells[0, 0] = size - cells.sum()
    return int((cells * np.abs(a.p[:, None] - b.p[None, :])).sum())


def _pairs(rows: pd.DataFrame) -> pd.DataFrame:
    """One block, two tiles of sources: what the block adds to the value of every pair."""
    first, out = rows.iloc[0], []
    tiles: list[list[_Group]] = [[], []]
    for row in rows.itertuples():
        tiles[int(row.tile != row.one)].append(_Group(row))
    for i, a in enumerate(tiles[0]):
        for b in tiles[1] if first["one"] != first["two"] else tiles[0][i + 1 :]:
            one, two = sorted((a.source, b.source))  # rows come in any order, but a pair has one name in all blocks
            out.append((first["lang"], one, two, difference(a, b, int(first["terms"]))))
    return pd.DataFrame(out, columns=["lang", "a", "b", "value"])


def audit(df: DataFrame, scratch, text: str = "text", lang: str = "lang", source: str = "source", support: int = SUPPORT, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank`` for all groups."""
    counts = scratch.keep(count_terms(df, text, lang, source), "counts")
    said = counts.where("term is not null")
    kept = said.groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs")).where(F.col("docs") >= support).drop("docs")
    kept = scratch.keep(kept, "kept")
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("all").alias("spoken"))
    # blocks by hash, so that no language's terms are ever put in order as a whole
    kept = kept.join(sizes, "lang").withColumn("blocks", F.ceil(F.col("kept") / (BLOCK_TERMS * 3 // 4)).cast("long"))
    kept = scratch.keep(kept.withColumn("block", F.pmod(F.xxhash64("term"), "blocks")), "dealt")  # written, so that places are given by block, not by language
    kept = kept.withColumn("place", F.row_number().over(Window.partitionBy("lang", "block").orderBy("term")) - 1)
    kept = scratch.keep(kept.select("lang", "term", "all", "spoken", "kept", "block", "place"), "blocks")
    held = said.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "all", "spoken", "kept", "block", "place")
    held = scratch.keep(held, "held")
    groups = counts.where("term is null").select("lang", "source")
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("whole"))
    groups = groups.join(totals, ["lang", "source"], "left").join(sizes.select("lang", "kept"), "lang", "left").fillna(0, ["whole", "kept"])
    groups = scratch.keep(groups, "groups")

    used = held.join(groups.select("lang", "source", "whole"), ["lang", "source"])
    value = share(F.col("n"), F.col("whole"), F.col("kept")) - share(F.col("all"), F.col("spoken"), F.col("kept"))
    more = used.select("lang", "source", F.col("term").alias("item"), value.cast("long").alias("value")).where("value > 0")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    by_term = more.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).withColumn("part", F.lit("term"))

    blocks = kept.groupBy("lang", "block").agg(F.count(F.lit(1)).alias("terms"))
    every = groups.join(blocks, "lang", "left").fillna(0, ["block", "terms"])  # a group has a place in every block of its language
    cells = held.groupBy("lang", "source", "block").agg(F.flatten(F.collect_list(F.array(F.col("n"), F.col("place").cast("long")))).alias("held"))  # no more than a block has terms
    levels = every.join(cells, ["lang", "source", "block"], "left").withColumn("held", F.coalesce("held", F.array().cast("array<bigint>")))
    bitmaps = F.pandas_udf(_levels, "counts array<long>, bits array<binary>")
    levels = levels.select("lang", "block", "source", "whole", "kept", "terms", bitmaps("held", "terms").alias("level")).select("lang", "block", "source", "whole", "kept", "terms", "level.counts", "level.bits")
    tiles = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / TILE_SOURCES).cast("long").alias("tiles"))
    levels = scratch.keep(levels, "levels").join(tiles, "lang").withColumn("tile", F.pmod(F.xxhash64("source"), "tiles"))
    levels = levels.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    levels = levels.withColumn("one", F.least("tile", "other")).withColumn("two", F.greatest("tile", "other"))
    found = levels.groupBy("lang", "block", "one", "two").applyInPandas(_pairs, "lang string, a string, b string, value long")
    found = scratch.keep(found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "pairs")
    both = found.unionByName(found.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    order = Window.partitionBy("lang", "a").orderBy(F.desc("value"), "b")
    by_pair = both.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value", F.row_number().over(order).alias("rank"))
    return by_pair.unionByName(by_term.select("lang", "source", "part", "item", "value", "rank"))
