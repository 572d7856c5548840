"""Grounding: where in its source does an extraction's text stand?

All texts of a document are searched in one pass over its source, which is held once, by an automaton of
all patterns; first as they are, then without white space on either side. Only texts and sources that
this doesn't bring together are looked at for their longest common block: at once where that takes little work,
by joins if it doesn't (see ``blocks``).

Sources travel in pieces, so that no batch holds many of them, and are put together one at a
time. Documents with over ``TEXTS`` texts are dealt to several tasks if they have more than one in ``HOT_SHARE``
of all texts; there can't be more of these than ``HOT_SHARE``, and they are broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from vitaeflow.functions.coerce import truthy
from vitaeflow.operators.blocks import BREAK, longest_blocks
from vitaeflow.operators.keys import cut, many, told

MIN_RATIO = 0.3
CONFIDENCE = {"exact": 1.0, "normalized": 0.85, "none": 0.1}
#: Share of a block's part of its text that counts as confidence.
FUZZY = 0.8
#: Characters of a piece of a source.
PIECE = 8192
TEXTS = 10_000
HOT_SHARE = 1000
#: Patterns of fewer characters are looked for one by one: an automaton would tell all their places.
SHORT = 4
#: In sources of this many characters those are common that stand there more than 1 + length // 100 times.
LONG, COMMON = 200, 100
#: Patterns are looked for one by one, too, while they times the characters of their source are no more than this.
PLAIN = 1 << 22
#: Rows that a task gathers before it hands them on: most documents have a few.
BATCH = 1000
#: Longest blocks are told at once while a text's characters that aren't common times its source's characters are
#: no more than this, and beyond it while all such texts of a source take no more than ``PATIENCE`` times as much.
SMALL, PATIENCE = 1 << 22, 1 << 8
_RUN = re.compile(f"[^{BREAK}]+")
_SPACE = np.array([chr(c).isspace() for c in range(0x3002)])  # the last one stands for all that follow


def codes_of(source: str) -> np.ndarray:
    return np.frombuffer(source.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def first_places(source: str, patterns: list[str]) -> list[int]:
    """The first place of each pattern in a source, -1 for none; if there is much to do, in one pass for all that
    aren't short."""
    if len(source) * len(patterns) <= PLAIN:
        return [source.find(p) for p in patterns]
    places = [source.find(p) if len(p) < SHORT else -1 for p in patterns]
    numbers: dict[str, list[int]] = {}
    for k, p in enumerate(patterns):
        if len(p) >= SHORT:
            numbers.setdefault(p, []).append(k)
    if not numbers:
        return places
    automaton = ahocorasick.Automaton()
    for p, own in numbers.items():
        automaton.add_word(p, (len(p), own))
    automaton.make_automaton()
    missing = len(numbers)
    for end, (size, own) in automaton.iter(source):
        if places[own[0]] < 0:
            for k in own:
                places[k] = end - size + 1
            missing -= 1
            if not missing:
                break
    return places


def find_all(source: str, texts: list[str]) -> list[tuple]:
    """(start, end, line, kind) of each text in a source; all None if it isn't found with or without white
    space. A text found without it ends where the next solid character stands."""
    codes = codes_of(source)
    ends = np.flatnonzero(codes == 10)
    line = lambda start: int(ends.searchsorted(start)) + 1
    out: list[tuple] = [(None, None, None, None)] * len(texts)
    left = []
    for k, at in enumerate(first_places(source, texts)):
        if at >= 0:
            out[k] = (at, at + len(texts[k]), line(at), "exact")
        else:
            left.append(k)
    if left:
        solid = np.flatnonzero(~_SPACE[np.minimum(codes, len(_SPACE) - 1)])
        place = lambda k: int(solid[k]) if k < len(solid) else len(source)
        queries = ["".join(texts[k].split()) for k in left]
        for k, query, at in zip(left, queries, first_places("".join(source.split()), queries), strict=True):
            if at >= 0:
                out[k] = (place(at), place(at + len(query)), line(place(at)), "normalized")
    return out


def common_characters(source: str) -> str:
    """The characters that make up more than a hundredth of a long source; there are less than a hundred."""
    if len(source) < LONG:
        return ""
    counts = np.bincount(codes_of(source))
    return "".join(map(chr, np.flatnonzero(counts > len(source) // COMMON + 1).tolist()))


def without(source: str, common: str) -> str:
    """A source with a break for each common character."""
    if not common or not source:
        return source
    codes = codes_of(source).copy()
    is_common = np.zeros(int(codes.max()) + 1, dtype=bool)
    is_common[list(map(ord, common))] = True
    codes[is_common[codes]] = ord(BREAK)
    return codes.tobytes().decode("utf-32-le", "surrogatepass")


def longest_block(text: str, source: str, runs: list[tuple[int, str]], masked: str) -> tuple[int, int]:
    """(start, size) in a source of the longest block it shares with a text, as ``blocks`` tells it. ``runs``: places
    and characters of what stands between the text's common characters, which are breaks in ``masked``."""
    n, i, j = 0, 0, 0
    for at, run in runs:
        k = 0
        while k + n < len(run):
            found = masked.find(run[k : k + n + 1])
            if found < 0:
                k += 1
                continue
            n += 1
            while k + n < len(run) and found + n < len(masked) and run[k + n] == masked[found + n]:
                n += 1
            i, j = at + k, found
    before, after = 0, 0
    while before < min(i, j) and text[i - before - 1] == source[j - before - 1]:
        before += 1
    while i + n + after < len(text) and j + n + after < len(source) and text[i + n + after] == source[j + n + after]:
        after += 1
    return j - before, before + n + after


def _blocks(source: str, texts: list[str], found: list[tuple], common: str, small: int) -> list[tuple]:
    """``found`` with (start, end, line, block) for the texts that weren't found and take little work: each of their
    characters that aren't common may be looked for in all of the source."""
    masked, mask = without(source, common), dict.fromkeys(map(ord, common), BREAK)
    out, left = [], small * PATIENCE
    for text, own in zip(texts, found, strict=True):
        if own[3] is None:
            runs = [(m.start(), m.group()) for m in _RUN.finditer(text.translate(mask))]
            work = sum(len(run) for _, run in runs) * len(source)
            if work > small:
                left -= work
            if work <= small or left >= 0:
                start, size = longest_block(text, source, runs, masked)
                own = (start, start + size, source.count("\n", 0, start) + 1, "block")
        out.append(own)
    return out


def _searching(key_type: pa.DataType, autojunk: bool | None):
    """Rows of one document are next to each other: the pieces of its source, then its texts in order."""

    names = ["doc_key", "text", "char_start", "char_end", "line", "match_type", "common"]
    kinds = dict(zip(names, [key_type, pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()], strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle() -> Iterator[pa.RecordBatch]:
            if texts and pieces:
                source = "".join(pieces)
                found = find_all(source, texts)
                common = common_characters(source) if any(x[3] is None for x in found) else None
                if common is not None and autojunk is not None:
                    found = _blocks(source, texts, found, common if autojunk else "", SMALL)
                rows = [[last[0]] * len(texts), texts, *zip(*found, strict=True), [common if x[3] is None else None for x in found]]
                for column, more in zip(held, rows, strict=True):
                    column.extend(more)
                yield from told(held, kinds, BATCH)

        held: list[list] = [[] for _ in names]
        last, pieces, texts = None, [], []
        for batch in batches:
            for key, part, at, body in zip(*(batch.column(c).to_pylist() for c in ("doc_key", "part", "at", "body")), strict=True):
                if (key, part) != last:
                    yield from settle()
                    last, pieces, texts = (key, part), [], []
                if at is not None:
                    pieces.append(body)
                elif not texts or body != texts[-1]:  # equal ones follow each other
                    if len(texts) >= 2 * TEXTS:
                        yield from settle()
                        texts = []
                    texts.append(body)
        yield from settle()
        yield from told(held, kinds)

    return run


def search(texts: DataFrame, documents: DataFrame, rows: DataFrame, autojunk: bool | None = None) -> DataFrame:
    """(doc_key, text, char_start, char_end, line, match_type, common) of the distinct ones of
    texts (doc_key, text) in documents (doc_key, text); match_type is exact, normalized or null, in which case ``common`` has the
    common characters of the source. ``rows``: what the texts were taken from; how many there are of a document
    bounds its texts. With ``autojunk`` given, small texts that aren't found have their longest block instead,
    with match_type block."""
    whole = F.coalesce("text", F.lit(""))
    bodies = F.regexp_extract_all(whole, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    sources = documents.select("doc_key", F.posexplode(F.when(F.length(whole) <= PIECE, F.array(whole)).otherwise(bodies)).alias("at", "body"))
    asked = texts.select("doc_key", F.lit(None).cast("int").alias("at"), F.col("text").alias("body"))
    counts = rows.groupBy("doc_key").agg(F.count("*").alias("n"))
    total, most = counts.agg(F.sum("n"), F.max("n")).first()
    if (most or 0) <= TEXTS:
        asked, dealt = asked.withColumn("part", F.lit(0)), sources.withColumn("part", F.lit(0))
    else:
        hot = cut(counts.filter((F.col("n") > TEXTS) & (F.col("n") * HOT_SHARE > total)).select("doc_key", F.ceil(F.col("n") / TEXTS).cast("int").alias("parts")))
        parts = F.coalesce("parts", F.lit(1))
        asked = asked.join(F.broadcast(hot), "doc_key", "left").withColumn("part", F.pmod(F.xxhash64("body"), parts).cast("int")).drop("parts")
        dealt = sources.join(F.broadcast(hot), "doc_key", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    both = dealt.unionByName(asked).repartition(many(texts.sparkSession), "doc_key", "part").sortWithinPartitions("doc_key", "part", F.asc_nulls_last("at"), "body")
    kind = texts.schema["doc_key"].dataType
    return both.mapInArrow(_searching(to_arrow_type(kind), autojunk), f"doc_key {kind.simpleString()}, text string, char_start int, char_end int, line int, match_type string, common string")


def asked_texts(extractions: DataFrame) -> DataFrame:
    """The texts to look for, by document; equal ones meet in the search."""
    return extractions.filter(truthy(F.col("text"))).select("doc_key", "text")


def text_id() -> Column:
    """What stands for a text within its document, so that texts needn't be kept or moved again."""
    return F.xxhash64("text").alias("text_id")


def locations(extractions: DataFrame, documents: DataFrame, min_ratio: float = MIN_RATIO, autojunk: bool = True, rows: DataFrame | None = None) -> DataFrame:
    """(doc_key, text_id, source_location) of the distinct texts that are found. ``rows``: the extractions again, if they
    are at hand in another form, where those of a document are counted with less work. The search runs at once, and
    what it finds is kept in the shared folder, with the texts only that are still to be looked for."""
    places = ("char_start", "char_end", "line", "match_type")
    missed = F.when(F.col("match_type").isNull(), F.col("text")).alias("text")
    found = cut(search(asked_texts(extractions), documents, extractions if rows is None else rows, autojunk).select("doc_key", text_id(), F.length("text").alias("length"), *places, "common", missed))
    sure = F.when(F.col("match_type") == "exact", CONFIDENCE["exact"]).otherwise(CONFIDENCE["normalized"])
    sure = found.filter("match_type IN ('exact', 'normalized')").select("doc_key", "text_id", *places, sure.alias("confidence"))
    blocks = found.filter("match_type = 'block'").select("doc_key", "text_id", "length", F.col("char_start").alias("start"), (F.col("char_end") - F.col("char_start")).alias("size"), "line")
    missing = found.filter("match_type IS NULL").select("doc_key", "text", ("common" if autojunk else F.lit("").alias("common")))
    if not missing.isEmpty():
        blocks = blocks.unionByName(longest_blocks(missing, documents).select("doc_key", text_id(), F.length("text").alias("length"), "start", "size", "line"))
    ratio = F.col("size") / F.col("length")
    fuzzy = blocks.filter((F.col("size") > 0) & (ratio >= min_ratio)).select(
        "doc_key", "text_id", F.col("start").alias("char_start"), (F.col("start") + F.col("size")).alias("char_end"), "line", F.lit("fuzzy").alias("match_type"), (ratio * FUZZY).alias("confidence")
    )
    every = sure.unionByName(fuzzy)
    return every.select("doc_key", "text_id", F.struct(*places, "confidence").alias("source_location"))


def told_location() -> Column:
    """source_location of an extraction: match_type none where its text isn't found, null without text."""
    nowhere = F.struct(
        *(F.lit(None).cast("int").alias(c) for c in ("char_start", "char_end", "line")), F.lit("none").alias("match_type"), F.lit(CONFIDENCE["none"]).alias("confidence")
    )
    return F.when(F.coalesce(truthy(F.col("text")), F.lit(False)), F.coalesce("source_location", nowhere)).alias("source_location")


def ground(extractions: DataFrame, documents: DataFrame, min_ratio: float = MIN_RATIO, autojunk: bool = True) -> DataFrame:
    """Adds source_location to every extraction; texts not found have match_type none, extractions
    without text no location. Sources meet distinct texts only; what comes back are places."""
    found = locations(extractions, documents, min_ratio, autojunk)
    plain = extractions.select(*(c for c in extractions.columns if c != "source_location"))
    return plain.withColumn("text_id", text_id()).join(found, ["doc_key", "text_id"], "left").select(*plain.columns, told_location())
