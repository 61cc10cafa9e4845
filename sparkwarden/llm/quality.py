"""Quality rules: line-first cleaning.

Each line is judged alone by punctuation, navigation and boilerplate rules; failing lines are removed; a document
that loses too much of its text is rejected. Beside that, whole-document counts (symbols, repeated lines, repeated
five-word windows) give a base verdict. Every document is judged by itself, so nothing is shuffled.

Null or empty text: no words, all counts 0, ``base_failed`` true, nothing kept; an empty table gives no rows. Repeated
rows are judged alike; null ids are carried through; other columns of the input, whatever their names, are left out of
the result. A text is judged whole, however long.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import SPACES, Words, covered, slices

BLANK = " \t\n\v\f\r"
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


@dataclass(frozen=True)
class QualityRules:
    """Line rules and limits. A text that loses over ``max_lost`` of its word characters is rejected."""

    max_symbols: float = 0.2  # of a line's characters
    separators: str = r"(?:^|\s)(?:\||»|›|>|·|•|::)(?=\s|$)"
    min_separators: int = 2
    boilerplate: tuple[str, ...] = (
        "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "click here",
        "enable javascript", "subscribe to our", "sign up for", "log in", "lorem ipsum", "powered by",
    )
    max_boilerplate_words: int = 30  # blanks; a longer line that merely mentions such a phrase stays
    max_lost: float = 0.5
    min_words: int = 10
    max_repeated_percent: int = 20


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_lines_removed long, cleaned string"
)


class LineRules:
    def __init__(self, rules: QualityRules):
        self.rules = rules
        self.symbols = "#*$%&|<>[]{}=_~^\\"
        self.letter = re.compile(r"[^\W_]")
        self.separator = re.compile(rules.separators)
        self.marks = "|»›>·•:"  # no separator without one of these

    def fails(self, line: str) -> bool:
        """Whether a line with a word is to be removed."""
        if not self.letter.search(line):  # punctuation alone
            return True
        if sum(map(line.count, self.symbols)) > self.rules.max_symbols * len(line):
            return True
        if any(c in line for c in self.marks) and len(self.separator.findall(line)) >= self.rules.min_separators:  # navigation
            return True
        if line.count(" ") >= self.rules.max_boilerplate_words:
            return False
        lowered = line.lower()
        return any(p in lowered for p in self.rules.boilerplate)

    def clean(self, text: str) -> tuple[str, int, int, int]:
        """The text without failing lines, how many failed, its lines that repeat an earlier one, and word characters left."""
        kept, failed, seen, chars = [], 0, Counter(), 0
        for line in text.split("\n"):
            if line.strip(BLANK):
                seen[line] += 1
                if self.fails(line):
                    failed += 1
                    continue
                chars += len(line) - sum(map(line.count, BLANK))
            kept.append(line)
        return "\n".join(kept), failed, seen.total() - len(seen), chars


def _judge(batch: pa.RecordBatch, line_rules: LineRules, rules: QualityRules) -> pa.RecordBatch:
    words = Words(batch.column("text"))
    doc_words = np.diff(words.first)
    in_word = ~SPACES[words.data]
    points = in_word & ((words.data & 0xC0) != 0x80)
    total = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[words.at])
    chars, symbols = total(points), total(SYMBOLS[words.data])
    window, whole = words.windows(5)
    doc = np.repeat(np.arange(len(doc_words)), doc_words)
    at = np.flatnonzero(whole)
    key = window[at] + doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    repeated = covered(at[count[back] > 1], 5, len(doc))
    repeats = np.bincount(doc[repeated], minlength=len(doc_words))
    cleaned, failed, dups, left = zip(*(line_rules.clean(t or "") for t in batch.column("text").to_pylist()))
    base = (doc_words < rules.min_words) | (100 * repeats > rules.max_repeated_percent * doc_words)
    lost = chars - np.array(left) > rules.max_lost * chars
    ints = [doc_words, chars, symbols, np.array(dups), repeats]
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in ints), pa.array(base), pa.array(~base & ~lost), pa.array(failed, pa.int64()), pa.array(cleaned, pa.string())],
        names=[c.split()[0] for c in SCHEMA.split(", ")],
    )


def quality(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """Judge every document of ``docs`` (doc_id, text); returns counts, verdicts and the cleaned text."""

    def run(batches):
        line_rules = LineRules(rules)
        for batch in batches:
            for piece in slices(batch, "text"):
                yield _judge(piece, line_rules, rules)

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, SCHEMA)


def op10(docs: DataFrame) -> DataFrame:
    """The columns of the contract."""
    return quality(docs).drop("n_lines_removed", "cleaned")


OP10_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), u AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM w
), k AS (
  SELECT doc_id, pos, word || chr(10) || lead(word, 1) OVER o || chr(10) || lead(word, 2) OVER o || chr(10) || lead(word, 3) OVER o || chr(10) || lead(word, 4) OVER o AS key
  FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
), r AS (
  SELECT doc_id, pos FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, key) AS c FROM k WHERE key IS NOT NULL) WHERE c > 1
), rep AS (
  SELECT doc_id, count(DISTINCT pos + j) AS n FROM r, range(5) t(j) GROUP BY 1
), l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w
), f AS (
  SELECT *, NOT regexp_matches(line, '[\p{L}\p{N}]') OR len(regexp_extract_all(line, '[#*$%&|<>\[\]{}=_~^\\]')) > 0.2e0 * length(line)
      OR len(regexp_extract_all(' ' || regexp_replace(line, '\s+', '  ', 'g') || ' ', ' ([|»›>·•]|::) ')) >= 2
      OR (length(line) - length(replace(line, ' ', '')) < 30 AND regexp_matches(lower(line), 'BOILERPLATE')) AS fails
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), g AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, coalesce(sum(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) FILTER (NOT fails), 0) AS left_chars FROM f GROUP BY 1
), a AS (
  SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, coalesce(left_chars, 0) AS left_chars
  FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id LEFT JOIN g ON g.doc_id = w.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND word_chars - left_chars <= 0.5e0 * word_chars AS kept FROM a
""".replace("BOILERPLATE", "|".join(QualityRules.boilerplate))
