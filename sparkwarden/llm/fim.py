"""Fill-in-middle transformation over relational units.

The text of a document is a sequence of units, matched from left to right. Cut requests name ordinals of units; where a
request falls in the text is found by relations: matches are exploded with their positions, window sums of their lengths
place them, requests join them by ordinal, and the offsets are put together for each document, which is then cut by
substring. Exploding every unit of a corpus would make a row of each code point, so it is done in two levels: first
runs of ``run`` units, of which windows sum units and code points; then the units of those runs alone that a request
falls into. Texts move once, dealt out by a number of their row and their id; all windows, joins and sums are on these
two, so nothing else is exchanged, and repeated ids are apart. Where the input has further columns, they move with a
second copy of the texts.

Null or empty text: no unit, form ``plain``, and the text is returned as empty. A null id is hashed as an empty string.
Repeated rows are cut alike, each by itself; an empty table stays empty. Texts are cut whole, however long.
``fill_in_middle`` adds n_units, form, prefix_chars, middle_chars and output; an added column whose name is taken gets
a ``_`` at its end.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import internal

CODE_POINT = "(?s:.)"
NO_ID = -(2**63)


@dataclass(frozen=True)
class FimRules:
    """``unit``: a pattern of at least one code point that looks at nothing around itself; code points that it does not match are units of their own."""

    unit: str = CODE_POINT
    run: int = 64
    seed: int = 1
    plain_from: int = 90  # shares of documents, of 100
    spm_below: int = 20
    prefix_mark: str = "<P>"
    suffix_mark: str = "<S>"
    middle_mark: str = "<M>"

    @property
    def one(self) -> str:
        return CODE_POINT if self.unit == CODE_POINT else f"(?>{self.unit}|{CODE_POINT})"

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix_mark, self.suffix_mark, self.middle_mark

    def drawn(self, k: int) -> Column:
        """The k-th (from 1) number of 32 bits that the column ``id`` gives."""
        name = F.coalesce(F.nullif(F.col("id"), F.lit(NO_ID)).cast("string"), F.lit(""))
        digest = F.sha2(F.concat(F.lit(f"{self.seed}:"), name), 256)
        return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")

    def count(self, text: str) -> Column:
        return (F.length(text) if self.unit == CODE_POINT else F.size(F.regexp_extract_all(text, F.lit(self.one), F.lit(0)))).cast("long")

    def form(self) -> Column:
        marked = F.length("text") == 0
        for mark in self.marks:
            marked |= F.contains("text", F.lit(mark))
        plain = marked | (self.drawn(3) % 100 >= self.plain_from)
        return F.when(plain, F.lit("plain")).when(self.drawn(4) % 100 < self.spm_below, F.lit("spm")).otherwise(F.lit("psm"))


def cut_requests(cut: DataFrame, rules: FimRules) -> DataFrame:
    """k, id, which (0: end of the prefix, 1: of the middle) and the ordinal of the last unit before the cut (0: none)."""
    numbered = cut.withColumn("n", rules.count("text") + 1)
    ends = [rules.drawn(j) % F.col("n") for j in (1, 2)]
    return numbered.select("k", "id", F.posexplode(F.array(F.least(*ends), F.greatest(*ends))).alias("which", "ordinal"))


def offsets(cut: DataFrame, requests: DataFrame, rules: FimRules) -> DataFrame:
    """k, id, prefix_end and middle_end: code points before the requested units of texts (k, id, text); null: none."""
    runs = cut.select("k", "id", F.posexplode(F.regexp_extract_all("text", F.lit(f"{rules.one}{{1,{rules.run}}}"), F.lit(0))).alias("run", "s"))
    runs = runs.select("k", "id", "run", F.length("s").alias("chars"), rules.count("s").alias("units"))
    earlier = Window.partitionBy("k", "id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumns({f"{c}_before": F.coalesce(F.sum(c).over(earlier), F.lit(0)) for c in ("units", "chars")})
    inside = (F.col("ordinal") > F.col("units_before")) & (F.col("ordinal") <= F.col("units_before") + F.col("units"))
    held = requests.join(runs, ["k", "id"]).where(inside).select("k", "id", "which", (F.col("ordinal") - F.col("units_before")).alias("rest"), "chars_before", "chars")
    piece = F.substring("text", F.col("chars_before") + 1, F.col("chars"))
    pieces = held.join(cut.select("k", "id", "text"), ["k", "id"]).select("k", "id", "which", "rest", "chars_before", F.posexplode(F.regexp_extract_all(piece, F.lit(rules.one), F.lit(0))).alias("unit", "u"))
    so_far = Window.partitionBy("k", "id", "which").orderBy("unit").rowsBetween(Window.unboundedPreceding, 0)
    ends = pieces.withColumn("end", F.col("chars_before") + F.sum(F.length("u")).over(so_far)).where("unit + 1 = rest")
    return ends.groupBy("k", "id").agg(*[F.max(F.when(F.col("which") == j, F.col("end"))).alias(name) for j, name in enumerate(("prefix_end", "middle_end"))])


def fill_in_middle(docs: DataFrame, rules: FimRules = FimRules()) -> DataFrame:
    """``docs`` (doc_id, text) with the form that each document's id draws, its cuts and its output."""
    others = [c for c in docs.columns if c.lower() not in ("doc_id", "text")]
    rows = docs.select(
        F.monotonically_increasing_id().alias("k"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *([F.struct(*[F.col(f"`{c}`") for c in others]).alias("row")] if others else []),
    )
    rows = rows.repartition("k", "id")
    cut = rows.select("k", "id", "text")  # plain ones too: a filter would go below the exchange and make it another
    found = offsets(cut, cut_requests(cut, rules), rules)
    both = rows.join(found, ["k", "id"], "left").withColumn("form", rules.form()).withColumns({c: F.when(F.col("form") != "plain", F.coalesce(c, F.lit(0))).cast("long") for c in ("prefix_end", "middle_end")})
    prefix = F.substring("text", F.lit(1), F.col("prefix_end").cast("int"))
    middle = F.substring("text", (F.col("prefix_end") + 1).cast("int"), (F.col("middle_end") - F.col("prefix_end")).cast("int"))
    suffix = F.substring("text", (F.col("middle_end") + 1).cast("int"), F.length("text"))
    p, s, m = map(F.lit, rules.marks)
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    added = {"n_units": rules.count("text"), "form": F.col("form"), "prefix_chars": F.col("prefix_end"), "middle_chars": F.col("middle_end") - F.col("prefix_end"), "output": output}
    kept = [F.nullif(F.col("id"), F.lit(NO_ID)).alias(c) if c.lower() == "doc_id" else F.col("text").alias(c) if c.lower() == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return both.select(*kept, *[x.alias(internal(docs, name)) for name, x in added.items()])


def restored(output: str, form: str, rules: FimRules = FimRules()) -> Column:
    """The text that the output in one column was made from, by the form in another."""

    def parts(first: str, second: str) -> list[Column]:
        body = F.substring(output, F.lit(len(first) + 1), F.length(output))
        one = F.substring_index(body, second, 1)
        rest = F.substring(body, F.length(one) + len(second) + 1, F.length(output))
        two = F.substring_index(rest, rules.middle_mark, 1)
        return [one, two, F.substring(rest, F.length(two) + len(rules.middle_mark) + 1, F.length(output))]

    prefix, suffix, middle = parts(rules.prefix_mark, rules.suffix_mark)
    suffix_, prefix_, middle_ = parts(rules.suffix_mark, rules.prefix_mark)
    return F.when(F.col(form) == "psm", F.concat(prefix, middle, suffix)).when(F.col(form) == "spm", F.concat(prefix_, middle_, suffix_)).otherwise(F.col(output))


def op13(docs: DataFrame) -> DataFrame:
    """The columns of the contract."""
    out = fill_in_middle(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored("output", "form"), 256).alias("restored_sha256"))


OP13_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), u AS (
  SELECT *, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d
), c AS (
  SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
    least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM u
), p AS (
  SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""
