"""Line-first quality rules, in DataFrame expressions only.

Each line is judged on its own: punctuation (a line of prose ends in a terminal mark), navigation
(separators between link names), boilerplate (legal and site phrases), symbols and shouting. Lines
that fail are removed. A document is then rejected when it lost too much of its text.

Everything happens inside the row: no join, no shuffle, and the whole text is judged.

Nulls and edge cases: a null or empty text, or one of white space only, has no words, fails the
base rules and is not kept; a null ``doc_id`` passes through; repeated rows are judged alike; an
empty table gives an empty result; other columns of the input are ignored by ``judge``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaeflow.llm.common import SPACE_CLASS, let, read, text_or_empty, trimmed, word_array

MIN_WORDS = 10
#: A text whose words stand in repeated windows to more than this percentage fails.
MAX_REPEAT_PERCENT = 20
WINDOW = 5
#: Lines with fewer words than this need no terminal mark.
PUNCTUATION_MIN_WORDS = 5
#: A document that keeps a smaller percentage of its word characters is rejected.
MIN_KEPT_PERCENT = 50

# Symbols counted by the base rules, link separators, terminal marks, phrases.
SYMBOLS = "#*$%&|<>"
NAVIGATION_MARKS = "|>»›·•"
TERMINAL_MARKS = "[.!?…。！？:;]"
#: Fixed value: quotes and brackets that may close a line after its terminal mark.
CLOSERS = "'\")]»”’"
BOILERPLATE_LINE = (
    r"(?i)\b(all rights reserved|terms of (use|service)|privacy policy|cookie policy|accept (all )?cookies|"
    r"enable javascript|lorem ipsum|click here|sign up|log in|subscribe now|back to top|powered by|skip to content)\b"
)


def _count_of(text: Column, chars: str) -> Column:
    found = f"[{chars}]"
    return F.when(text.rlike(found), F.length(text) - F.length(F.regexp_replace(text, found, ""))).otherwise(0).cast("long")


def window_hashes(words: Column) -> Column:
    """A hash for every window of ``WINDOW`` words; none: empty array."""
    last = F.size(words) - F.lit(WINDOW - 1)
    return F.when(last < 1, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    )


def repeated_words(hashes: Column) -> Column:
    """Words that stand in a window which the text has at least twice, from the windows' hashes."""
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))

    def twice(ordered: Column) -> Column:
        marked = F.transform(
            ordered,
            lambda x, i: F.when((F.get(ordered, i - 1)["h"] == x["h"]) | (F.get(ordered, i + 1)["h"] == x["h"]), x["at"]),
        )
        return F.array_sort(F.filter(marked, lambda at: at.isNotNull()))

    def length(starts: Column) -> Column:
        steps = F.transform(starts, lambda at, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - at, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    # Most texts repeat nothing, which the set of hashes shows without sorting.
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(let(pairs, twice), length)).cast("long")


def line_fails(line: Column, phrases: Column) -> Column:
    """Whether a line with words breaks one of the line rules; ``phrases``: its text holds a
    boilerplate phrase. Cheap tests come first, words are counted only where they matter."""
    body = trimmed(line)
    n = F.size(F.split(body, SPACE_CLASS + "+"))
    marks = _count_of(line, NAVIGATION_MARKS)
    upper = F.length(F.regexp_replace(line, r"[^\p{Lu}]+", ""))
    letters = F.length(F.regexp_replace(line, r"[^\p{L}]+", ""))
    navigation = line.rlike(f"[{NAVIGATION_MARKS}]") & (marks >= 3) & (marks * 5 >= n)
    last = F.substring(body, -1, 1)  # few lines end in closers, which take longer
    unfinished = ~F.when(F.lit(CLOSERS).contains(last), F.substring(F.rtrim(body, F.lit(CLOSERS)), -1, 1)).otherwise(last).rlike(TERMINAL_MARKS) & (n >= PUNCTUATION_MIN_WORDS)
    symbols = line.rlike(f"[{SYMBOLS}]") & (_count_of(line, SYMBOLS) * 2 >= n)
    shouting = line.rlike(r"\p{Lu}{2}") & (letters >= 10) & (upper * 10 >= letters * 7) & (n >= PUNCTUATION_MIN_WORDS)
    return navigation | unfinished | symbols | shouting | (phrases & line.rlike(BOILERPLATE_LINE))


def failing_lines(text: Column, phrases: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: (trimmed(line) != "") & line_fails(line, phrases))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, the base verdict, the word characters kept and the verdict."""
    text = F.col("text")
    words = F.col("words")
    lines = F.filter(F.split(text, "\n"), lambda line: trimmed(line) != "")
    lost = F.transform(failing_lines(text, F.col("phrases")), lambda line: F.array_join(word_array(line), ""))
    base = (
        docs.select("doc_id", text_or_empty().alias("text"))
        .select("doc_id", "text", word_array(text).alias("words"), text.rlike(BOILERPLATE_LINE).alias("phrases"))
        .select("*", window_hashes(words).alias("hashes"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"), lines.alias("lines"))
        .select(
            "doc_id",
            F.size(words).cast("long").alias("n_words"),
            "word_chars",
            _count_of(text, SYMBOLS).alias("n_symbols"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            repeated_words(F.col("hashes")).alias("n_repeat_words"),
            (F.col("word_chars") - F.length(F.array_join(lost, ""))).cast("long").alias("kept_chars"),
        )
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return base.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (100 * F.col("kept_chars") >= MIN_KEPT_PERCENT * F.col("word_chars"))
    )


def clean(docs: DataFrame) -> DataFrame:
    """The documents' rows with the failing lines taken out of ``text``; null texts stay null."""
    text = F.col("text")
    kept = F.filter(F.split(text, "\n"), lambda line: (trimmed(line) == "") | ~line_fails(line, F.lit(True)))
    return docs.withColumn("text", F.array_join(kept, "\n"))


def op7_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict for every document."""
    return judge(read(spark, sf_dir, "documents"))


_SPACE = r"[\x20\x09-\x0D]"
ORACLE_SQL = {
    "op7_line_quality": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT rid, i, array_to_string(ws[i:i + {WINDOW - 1}], chr(32)) AS k
        FROM (SELECT rid, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) >= {WINDOW})),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + {WINDOW})) AS p FROM twice) GROUP BY rid),
ln AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d),
lw AS (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws,
         length(regexp_replace(line, '{_SPACE}', '', 'g')) AS chars,
         length(regexp_replace(line, '[^|>»›·•]', '', 'g')) AS marks,
         length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS syms,
         length(regexp_replace(line, '[^\p{{Lu}}]', '', 'g')) AS ups,
         length(regexp_replace(line, '[^\p{{L}}]', '', 'g')) AS lets
       FROM ln),
judged AS (SELECT *, (marks >= 3 AND marks * 5 >= len(ws))
    OR (len(ws) >= {PUNCTUATION_MIN_WORDS} AND NOT regexp_matches(regexp_replace(line, '{_SPACE}+$', ''), '[.!?…。！？:;][''")\]»”’]*$'))
    OR syms * 2 >= len(ws)
    OR (len(ws) >= {PUNCTUATION_MIN_WORDS} AND regexp_matches(line, '\p{{Lu}}{{2}}') AND lets >= 10 AND ups * 10 >= lets * 7)
    OR regexp_matches(line, '{BOILERPLATE_LINE}') AS bad
  FROM lw WHERE len(ws) > 0),
perdoc AS (SELECT rid, count(*) - count(DISTINCT line) AS dups, sum(CASE WHEN bad THEN 0 ELSE chars END) AS kept_chars FROM judged GROUP BY rid),
r AS (SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(t, '{_SPACE}', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(p.dups, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
  CAST(coalesce(p.kept_chars, 0) AS BIGINT) AS kept_chars
  FROM w LEFT JOIN rep USING (rid) LEFT JOIN perdoc p USING (rid))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)
    AND 100 * kept_chars >= {MIN_KEPT_PERCENT} * word_chars AS kept
FROM r
"""
}
QUERIES = {"op7_line_quality": op7_line_quality}
