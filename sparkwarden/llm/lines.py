"""Line dedup, DataFrame functions only.

Lines that stand once are set aside: no run goes through them. What is left of the documents' line sequences is sorted
into a suffix array by distributed prefix doubling. At depth 1 the key of a suffix is the rank of its line's 128-bit id;
at depth 2d suffixes whose keys still tie are told apart by the keys d lines on, and the rank of that pair is appended, so
keys compare like the suffixes do. Doubling ends when no two suffixes tie that could go on, that is at the longest
repeated run. Neighbours in the array are then compared exactly: keys that have m ranks in common share 2**(m-1) lines,
and both suffixes move on by as many (for deletion, up to ``min_lines``). Those common prefixes cut the array into intervals: all suffixes between two places
where the prefix falls below d lines share d lines, and those after the interval's first place are later copies.

A run is deleted where it also starts earlier, if it has ``min_lines`` lines or ``min_chars`` characters in all (line
breaks not counted); so short runs go by their whole content, and what stays of repeated text is runs that are short in
both. Maximal repeated runs are given by ``repeated_runs``.

Order is (doc_id, line), null ids first. Rows that share an id are told apart by a hash of their text; rows equal in
both are one document and get the same result. Null text has no lines and stays null; empty text is one empty line. An
empty table stays empty. Other columns are carried through; those that are added get names that the input does not have.
A text's lines are rebuilt in one pass, however many there are.

A line that a third of all documents hold costs one partial aggregate from each task. Joins on lines and keys have both
sides written, so adaptive execution splits them; no group is gathered. Windows over the array go by range partition, and
what passes from one to the next is one row a partition.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Scratch, internal, result

KEY = "array<long>"


def _ranked(pairs: DataFrame) -> DataFrame:
    """Distinct rows in order, with ``seq``: numbers that ascend with them, from range partitions without a gather."""
    return pairs.orderBy(*[c for c in pairs.columns if c != "n"]).withColumn("seq", F.monotonically_increasing_id())


def _repeated_lines(docs: DataFrame, depths: int, scratch: Scratch) -> DataFrame:
    """Places (i, h, pos) of lines that stand twice, with the key at depth 1, ``left`` (lines up to the next that stands once, or the end) and ``chars`` (of 1 to ``depths`` lines)."""
    lines = docs.select(F.col("doc_id").alias("i"), F.xxhash64("text").alias("h"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.select("i", "h", "pos", F.unhex(F.md5("line")).alias("line"), F.length("line").cast("long").alias("size"))
    ranks = scratch.write(_ranked(lines.groupBy("line").agg(F.count("*").alias("n")).where("n > 1").select("line")), "ranks")
    twice = lines.join(ranks, "line").repartition("i", "h").dropDuplicates(["i", "h", "pos"])
    order = Window.partitionBy("i", "h").orderBy("pos")
    run = twice.withColumn("run", F.col("pos") - F.row_number().over(order))
    ahead = Window.partitionBy("i", "h", "run").orderBy("pos")
    chars = F.array(*(F.sum("size").over(ahead.rowsBetween(0, d)) for d in range(depths)))
    left = F.max("pos").over(ahead.rowsBetween(0, Window.unboundedFollowing)) - F.col("pos") + 1
    return scratch.write(run.select("i", "h", "pos", F.array("seq").cast(KEY).alias("key"), left.alias("left"), chars.alias("chars")), "places")


def _ahead(by: int) -> Column:
    """The key ``by`` lines on."""
    return F.first("key").over(Window.partitionBy("i", "h").orderBy("pos").rangeBetween(by, by))


def suffix_array(docs: DataFrame, depths: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Places with their keys, and the array: each distinct key in order (``seq``, ``part``) with how many places have it, their first, and ``left``."""
    places = _repeated_lines(docs, depths, scratch).withColumn("open", F.lit(True))
    columns, settled = [c for c in places.columns if c != "open"], []
    depth = 1
    while True:
        # a suffix that ends after ``depth`` lines sorts before those that go on
        following = F.when(F.col("open") & (F.col("left") > depth), _ahead(depth)).when(F.col("open") & (F.col("left") == depth), F.array().cast(KEY))
        alive = F.max(F.col("next").isNotNull()).over(Window.partitionBy("i", "h"))
        step = scratch.write(places.withColumn("next", following).withColumn("alive", alive), f"depth{depth}")
        settled.append(step.where("not alive").select(*columns))  # these documents take no part in further rounds
        active = step.where("next is not null")
        ranks = scratch.write(_ranked(active.groupBy("key", "next").agg(F.count("*").alias("n"))), f"ranks{depth}")
        if ranks.isEmpty():
            break
        longer = active.join(ranks, ["key", "next"])
        longer = longer.withColumns({"key": F.concat("key", F.array("seq")), "open": (F.col("n") > 1) & (F.col("left") > depth)})
        places = step.where("alive and next is null").withColumn("open", F.lit(False)).select(*columns, "open").unionByName(longer.select(*columns, "open"))
        depth *= 2
    found = scratch.write(reduce(DataFrame.unionByName, settled), "sorted")
    place = F.struct("i", "h", "pos")
    keys = found.groupBy("key").agg(F.count("*").alias("n"), F.min(place).alias("first"), F.min("left").alias("left"))
    array = keys.orderBy("key").withColumns({"seq": F.monotonically_increasing_id(), "part": F.spark_partition_id()})
    return found, scratch.write(array, "array")


def _same(a: str, b: str) -> Column:
    """How many leading ranks two keys have in common."""
    unlike = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False).cast("int")
    return F.when(unlike > 0, unlike - 1).otherwise(F.size(a))


def common_prefixes(places: DataFrame, array: DataFrame, scratch: Scratch, enough: int | None = None) -> DataFrame:
    """The array with ``lcp``: the lines that a key's suffixes have in common with those of the key before (or ``enough`` and perhaps more)."""
    within = Window.partitionBy("part").orderBy("seq")
    ends = array.groupBy("part").agg(F.max_by(F.struct("first", "key"), "seq").alias("last"))
    before = ends.select("part", F.lag("last").over(Window.orderBy("part")).alias("last"))  # one row a partition
    pairs = array.join(F.broadcast(before), "part").withColumn("before", F.coalesce(F.lag(F.struct("first", "key")).over(within), "last"))
    more = F.lit(True) if enough is None else F.col("lcp") < enough
    open_ = scratch.write(pairs.select("seq", F.col("first").alias("a"), F.col("before.first").alias("b"), F.col("key").alias("x"), F.col("before.key").alias("y"), F.lit(0).alias("lcp")), "pairs")
    by = F.when(_same("x", "y") > 0, F.pow(F.lit(2), _same("x", "y") - 1)).otherwise(0).cast("int")
    at_once = F.when(F.col("y").isNull(), 0).otherwise(by)
    known = F.col("y").isNull() | (_same("x", "y") == 0) | (F.lit(False) if enough is None else by >= enough)
    done = open_.where(known).select("seq", at_once.alias("lcp"))
    open_ = open_.where(~known)
    while not open_.isEmpty():
        moved = open_.withColumn("by", by).select("seq", (F.col("lcp") + F.col("by")).alias("lcp"), *(F.struct(F.col(f"{c}.i").alias("i"), F.col(f"{c}.h").alias("h"), (F.col(f"{c}.pos") + F.col("by")).alias("pos")).alias(c) for c in "ab"))
        for c, key in (("a", "x"), ("b", "y")):
            there = places.select(F.col("i").alias("pi"), F.col("h").alias("ph"), F.col("pos").alias("pp"), F.col("key").alias(key), F.col("left").alias(f"left_{c}"))
            moved = moved.join(there, F.col(f"{c}.i").eqNullSafe(F.col("pi")) & (F.col(f"{c}.h") == F.col("ph")) & (F.col(f"{c}.pos") == F.col("pp")), "left").drop("pi", "ph", "pp")
        step = scratch.write(moved, "moved")
        on = F.coalesce((F.col("x") != F.col("y")) & (_same("x", "y") > 0), F.lit(False)) & more
        # of equal keys the rest is equal
        done = done.unionByName(step.where(~on).select("seq", F.when(F.col("x") == F.col("y"), F.col("lcp") + F.col("left_a")).otherwise(F.col("lcp")).alias("lcp")))
        open_ = step.where(on)
    return scratch.write(array.join(done, "seq"), "prefixes")


def intervals(prefixes: DataFrame, depths: int, scratch: Scratch) -> DataFrame:
    """key and ``firsts``: for 1 to ``depths`` lines, the first place of the interval of the array that the key lies in."""
    within = Window.partitionBy("part").orderBy("seq")
    starts = [F.when(F.col("lcp") < d, F.col("seq")) for d in range(1, depths + 1)]
    last = prefixes.groupBy("part").agg(*(F.max(s).alias(f"s{d}") for d, s in enumerate(starts)))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    carried = last.select("part", *(F.max(f"s{d}").over(before).alias(f"s{d}") for d in range(depths)))
    held = prefixes.join(F.broadcast(carried), "part")
    held = held.withColumns({f"s{d}": F.coalesce(F.last(s, ignorenulls=True).over(within), f"s{d}") for d, s in enumerate(starts)})
    start = [F.struct(F.lit(d + 1).alias("d"), F.col(f"s{d}").alias("start")) for d in range(depths)]
    named = scratch.write(held.select("seq", "key", "first", F.explode(F.array(*start)).alias("s")).select("seq", "key", "first", "s.*"), "intervals")
    firsts = scratch.write(named.groupBy("d", "start").agg(F.min("first").alias("least")), "firsts")
    of = named.join(firsts, ["d", "start"]).groupBy("seq").agg(F.sort_array(F.collect_list(F.struct("d", "least"))).alias("firsts"))
    return scratch.write(named.where("d = 1").select("seq", "key").join(of, "seq").drop("seq"), "keys")


def _sorted(docs: DataFrame, depths: int, scratch: Scratch, enough: int | None = None) -> tuple[DataFrame, DataFrame]:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    places, array = suffix_array(docs, depths, scratch)
    return places, common_prefixes(places, array, scratch, enough)


def repeated_runs(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), line and n_lines: every maximal run of lines that also stands elsewhere (it cannot be longer to either side)."""
    with Scratch(docs.sparkSession) as scratch:
        places, prefixes = _sorted(docs, 1, scratch)
        within = Window.partitionBy("part").orderBy("seq")
        firsts = prefixes.groupBy("part").agg(F.min_by("lcp", "seq").alias("after"))
        after = firsts.select("part", F.lead("after").over(Window.orderBy("part")).alias("after"))  # one row a partition
        next_lcp = F.coalesce(F.lead("lcp").over(within), "after", F.lit(0))
        longest = prefixes.join(F.broadcast(after), "part").select("key", F.greatest("lcp", next_lcp, F.when(F.col("n") > 1, F.col("left")).otherwise(0)).alias("n_lines"))
        runs = places.join(scratch.write(longest, "longest"), "key")
        before = F.first("n_lines").over(Window.partitionBy("i", "h").orderBy("pos").rangeBetween(-1, -1))
        runs = runs.withColumn("before", F.coalesce(before, F.lit(0))).where("n_lines >= before and n_lines > 0")
        return result(runs.select(F.col("i").alias("doc_id"), "h", F.col("pos").alias("line"), "n_lines"), "runs")


def late_lines(docs: DataFrame, min_lines: int, min_chars: int, scratch: Scratch) -> DataFrame:
    """i (doc_id), h (hash of the text) and gone: the places of the lines to delete, of documents that have any."""
    places, prefixes = _sorted(docs, min_lines, scratch, min_lines)
    found = places.join(intervals(prefixes, min_lines, scratch), "key")
    late = lambda d: (F.col("left") >= d) & (F.struct("i", "h", "pos") > F.col("firsts")[d - 1]["least"])
    size = F.lit(0)
    for d in range(1, min_lines):
        size = F.when(late(d) & (F.col("chars")[d - 1] >= min_chars), d).otherwise(size)
    size = F.when(late(min_lines), min_lines).otherwise(size)
    runs = found.withColumn("size", size).where("size > 0").select("i", "h", F.explode(F.sequence("pos", F.col("pos") + F.col("size") - 1)).alias("pos"))
    return result(runs.groupBy("i", "h").agg(F.collect_set("pos").alias("gone")), "gone")


def dedup_lines(docs: DataFrame, min_lines: int = 3, min_chars: int = 40) -> DataFrame:
    """``docs`` (doc_id, text and any others) with later copies deleted from text, and n_lines and n_removed added (long).

    Texts without a deletion are unchanged. The places of the lines to delete are a table in the shared folder.
    """
    with Scratch(docs.sparkSession) as scratch:
        gone = late_lines(docs, min_lines, min_chars, scratch)
    i, h, g, n_lines, n_removed = (internal(docs, x) for x in ("i", "h", "gone", "n_lines", "n_removed"))
    gone = gone.select(F.col("i").alias(f"{i}r"), F.col("h").alias(f"{h}r"), F.col("gone").alias(g))
    text = F.col("text").cast("string")
    keyed = docs.withColumns({i: F.col("doc_id").cast("long"), h: F.xxhash64(text)})
    # merged at every size: a broadcast would only hold while the deletions are few
    joined = keyed.join(gone.hint("merge"), keyed[i].eqNullSafe(F.col(f"{i}r")) & (keyed[h] == F.col(f"{h}r")), "left")
    split = F.split(text, "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(split) - F.lit(1)), F.col(g))
    # bound as a variable, the lines are split once and not again for each that is kept
    kept = F.transform(F.array(split), lambda lines: F.array_join(F.transform(left, lambda k: F.get(lines, k)), "\n"))[0]
    counts = {n_lines: F.when(text.isNull(), 0).otherwise(F.size(split)).cast("long"), n_removed: F.when(F.col(g).isNull(), 0).otherwise(F.size(g)).cast("long")}
    out = joined.withColumns(counts).withColumn("text", F.when(F.col(g).isNull(), text).otherwise(kept))
    return out.drop(i, h, g, f"{i}r", f"{h}r")


def op5(docs: DataFrame) -> DataFrame:
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL
), w AS (
  SELECT doc_id, pos, line, lead(line, 1) OVER d AS b, lead(line, 2) OVER d AS c FROM l WINDOW d AS (PARTITION BY doc_id ORDER BY pos)
), late AS (
  SELECT doc_id, pos, length(line) >= 40 AND row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) > 1 AS one,
         b IS NOT NULL AND length(line) + length(b) >= 40 AND row_number() OVER (PARTITION BY line, b ORDER BY doc_id, pos) > 1 AS two,
         c IS NOT NULL AND row_number() OVER (PARTITION BY line, b, c ORDER BY doc_id, pos) > 1 AS three
  FROM w
), gone AS (
  SELECT doc_id, pos FROM late WHERE one UNION SELECT doc_id, pos + k FROM late, (SELECT unnest(range(2)) AS k) WHERE two UNION SELECT doc_id, pos + k FROM late, (SELECT unnest(range(3)) AS k) WHERE three
), kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed, string_agg(CASE WHEN g.pos IS NULL THEN line END, chr(10) ORDER BY l.pos) AS kept
  FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
