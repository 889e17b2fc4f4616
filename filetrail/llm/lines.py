"""Line dedup: suffixes of line sequences sorted by prefix doubling; maximal runs of lines that an earlier place has are deleted."""

from __future__ import annotations

import hashlib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filetrail.llm.common import keep_stores, stage


def full_lines(text: Column) -> Column:
    """The lines that hold more than blanks (spaces alone, as in `shortened`); a blank line belongs to the line before it."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: F.trim(line) != "")


def line_ids(text: Column) -> Column:
    """Hashes of the full lines."""
    return F.transform(full_lines(text), lambda line: F.xxhash64(line))


def passages(text: Column, words: int | None) -> Column:
    """Positions, among the full lines, of those with `words` words or more (what lies between ASCII white space)."""
    if words is None:
        return F.lit(None).cast("array<int>")
    long = F.transform(full_lines(text), lambda line, i: F.when(
        (F.length(line) >= 2 * words - 1) & (F.regexp_count(line, F.lit("[^ \\x09-\\x0D]+")) >= words), i))
    return F.filter(long, lambda i: i.isNotNull())


def _several(suffixes: DataFrame, keys: list[str]) -> DataFrame:
    """Classes of suffixes with equal keys that have several members, in the order of the keys: rank, n, first (its first place).

    Ranks come from sorted ranges, so they keep the order of the suffixes; counting is combined before it is shuffled.
    """
    classes = stage(suffixes.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min(F.struct("doc_id", "text_key", "pos")).alias("first")).filter("n > 1"), "line-classes")
    ordered = classes.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return stage(ordered.withColumn("rank", F.monotonically_increasing_id()), "line-ranks")


def suffix_levels(sequences: DataFrame, run: int) -> list[tuple[int, DataFrame]]:
    """[(depth, suffixes)]: the suffixes whose first `depth` lines begin several suffixes, sorted to that depth, for depths 1, 2, 4, ..,
    `run`, 2 * `run`, .. until no class has two members.

    Columns: text_key, doc_id, pos, rank, first (the class's first place); at depth 1 also passage. `sequences` has text_key, doc_id, ids,
    passages. Prefix doubling: the order by the first h lines gives that by the first 2h (the round that reaches `run` overlaps). Suffixes
    that are alone in their class drop out, and with them all that contain them: no longer run of theirs is repeated. A class is an interval
    of the suffix array with common prefixes of `depth` lines or more, [rank, rank of the next class).
    """
    active = sequences.select("text_key", "doc_id", "passages", F.posexplode("ids").alias("pos", "id"))
    active = active.withColumn("passage", F.coalesce(F.array_contains("passages", F.col("pos")), F.lit(False)))
    classes = _several(active, ["id"])
    active = stage(active.join(classes, "id").select("text_key", "doc_id", "pos", "rank", "first", "passage"), "line-suffixes")
    depth, levels = 1, [(1, active)]
    while depth < run or not active.isEmpty():
        step = min(depth, run - depth) if depth < run else depth
        after = active.select("text_key", (F.col("pos") - step).alias("pos"), F.col("rank").alias("next"))
        pairs = active.select("text_key", "doc_id", "pos", "rank").join(after, ["text_key", "pos"])
        active = stage(pairs.join(_pairs(pairs), ["rank", "next"]).select(
            "text_key", "doc_id", "pos", F.col("new").alias("rank"), "first"), "line-suffixes")
        depth += step
        levels.append((depth, active))
    return levels


def _pairs(pairs: DataFrame) -> DataFrame:
    named = _several(pairs.withColumnRenamed("rank", "left"), ["left", "next"])
    return named.select(F.col("left").alias("rank"), "next", F.col("rank").alias("new"), "first")


PLACE = ["doc_id", "text_key", "pos"]  # in the order of documents, then lines


def maximal_runs(levels: list[tuple[int, DataFrame]], run: int) -> DataFrame:
    """(text_key, doc_id, pos, length, first): the maximal runs of `run` lines or more that an earlier place has too.

    A suffix is matched with the first place of the deepest class in which it is not first itself. Of matches that continue one another line
    by line the first stays, so a long copy is one run. Its length is the common prefix of both suffixes, found by descent: from
    the deepest class's depth on, the ranks of what follows are compared at each smaller depth. Any line that lies in a
    later copy of `run` lines lies in one of these runs, and no other does.
    """
    later = [df.filter(F.struct(*PLACE) != F.col("first")).select(*PLACE, "first", F.lit(d).alias("depth")) for d, df in levels if d >= run]
    matched = reduce(DataFrame.unionByName, later).groupBy(*PLACE).agg(
        F.max("depth").alias("depth"), F.max_by("first", "depth").alias("first"))
    matched = stage(matched.withColumns({"of": F.col("first.text_key"), "at": F.col("first.pos")}), "line-matches")
    before = matched.select("text_key", "of", (F.col("pos") + 1).alias("pos"), (F.col("at") + 1).alias("at"))
    runs = stage(matched.join(before, ["text_key", "of", "pos", "at"], "left_anti").withColumn("length", F.col("depth")), "line-runs")
    for depth, level in reversed(levels[:-1]):
        asking = runs.filter(F.col("depth") > depth).select(
            "text_key", "pos", "of", (F.col("pos") + F.col("length")).alias("own_next"), (F.col("at") + F.col("length")).alias("of_next"))
        own = level.select("text_key", F.col("pos").alias("own_next"), "rank")
        other = level.select(F.col("text_key").alias("of"), F.col("pos").alias("of_next"), "rank")
        longer = asking.join(own, ["text_key", "own_next"]).join(other, ["of", "of_next", "rank"]).select(
            "text_key", "pos", F.lit(depth).alias("more"))
        runs = stage(runs.join(longer, ["text_key", "pos"], "left").withColumn(
            "length", F.col("length") + F.coalesce("more", F.lit(0))).drop("more"), "line-runs")
    return runs.select(*PLACE, "length", "first")


def _sequences(docs: DataFrame, run: int, words: int | None) -> tuple[DataFrame, DataFrame]:
    """Line ids of every document that has something to compare, and of the first document of each text."""
    rows = docs.select(
        F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), line_ids(F.col("text")).alias("ids"),
        passages(F.col("text"), words).alias("passages"))
    sequences = stage(rows.filter((F.size("ids") >= run) | (F.size("passages") > 0)), "line-sequences")
    firsts = sequences.groupBy("text_key").agg(
        F.min(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("doc_id"), F.first("ids").alias("ids"), F.first("passages").alias("passages"))
    return sequences, stage(firsts, "line-firsts")


def repeated_runs(docs: DataFrame, run: int = 2) -> DataFrame:
    """(doc_id, line, length, first_doc_id, first_line): the maximal runs of `run` lines or more that are later copies, with their first place.

    Lines count the full lines from 0. Of equal texts the first document is listed; null doc_ids come as null. Tables without repeats give no row.
    """
    _, firsts = _sequences(docs, run, None)
    known = lambda c: F.when(F.col(c) != F.lit(-(1 << 63)), F.col(c))
    return maximal_runs(suffix_levels(firsts, run), run).select(
        known("doc_id").alias("doc_id"), F.col("pos").alias("line"), "length", known("first.doc_id").alias("first_doc_id"),
        F.col("first.pos").alias("first_line"))


def deletions(docs: DataFrame, run: int = 2, words: int | None = None) -> DataFrame:
    """(text_key, doc_id, copy, runs, alone) of the documents that lose lines: later copies of maximal runs (pos, length) and places of
    later copies of passages, or the whole as a copy.

    Documents are in the order of doc_id (null first), then of their text's hash. Of equal texts the first goes through the suffix
    array; the others are copies of it from end to end, so however many there are, they add nothing to sort. Texts of fewer than
    `run` lines are there for their passages only.
    """
    sequences, firsts = _sequences(docs, run, words)
    levels = suffix_levels(firsts, run)
    span = F.struct("pos", "length")
    later = maximal_runs(levels, run).select("text_key", "doc_id", span.alias("span"), F.lit(None).cast("int").alias("passage"))
    if words is not None:
        alone = levels[0][1].filter("passage").filter(F.struct(*PLACE) != F.col("first"))
        later = later.unionByName(alone.select("text_key", "doc_id", F.col("pos").alias("passage")), allowMissingColumns=True)
    later = later.groupBy("text_key", "doc_id").agg(
        F.array_sort(F.collect_list("span")).alias("runs"), F.array_sort(F.collect_list("passage")).alias("alone"))
    own = sequences.select("text_key", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), "passages", (F.size("ids") >= run).alias("copy"))
    copies = own.join(firsts.select("text_key", F.col("doc_id").alias("kept")), "text_key").filter("doc_id != kept").select(
        "text_key", "doc_id", "copy", F.when(~F.col("copy"), F.col("passages")).alias("alone")).dropDuplicates(["text_key", "doc_id"])
    return stage(later.withColumn("copy", F.lit(False)).unionByName(copies, allowMissingColumns=True), "line-deletions")


def shortened(text: str, runs, alone, copy: bool) -> tuple[str, int, int]:
    """The text without the lines of those runs (pos, length; in order) and passages, how many lines went, in how many maximal stretches."""
    lines = text.split("\n")
    gone: set[int] = set() if alone is None else set(alone)
    end = 0
    for r in () if runs is None else runs:
        gone.update(range(max(r["pos"], end), r["pos"] + r["length"]))
        end = max(end, r["pos"] + r["length"])
    kept, went, stretches, nth, before = [], 0, 0, -1, False
    for line in lines:
        full = line.strip(" ") != ""
        nth += full
        goes = nth >= 0 and (copy or nth in gone)
        if full:
            went += goes
            stretches += goes and not before
            before = goes
        if not goes:
            kept.append(line)
    return "\n".join(kept), went, stretches


def dedup_lines(docs: DataFrame, run: int = 2, report: bool = False, words: int | None = None) -> DataFrame:
    """Delete every line that lies in a run of `run` lines which begins at an earlier place too; all rows and columns stay.

    With `words`, a line of that many words or more (a passage) also goes where it is at an earlier place, whatever is around it.

    Earlier means a smaller (doc_id, text's hash, line); what is repeated is judged on the input. Lines are what lies between line ends;
    lines of blanks alone are in no run and go with the line before them. Null texts stay null, texts left without lines become
    empty, texts of fewer than `run` lines can lose passages only. Rows that are equal in doc_id and text are one document and keep their lines. A
    column `n_chars` gets the new length. With `report` the result is doc_id, n_lines (not blank), n_deleted, n_stretches,
    kept_sha256 instead.
    """
    found = deletions(docs, run, words)
    own = {c: f"own_{i}" for i, c in enumerate(docs.columns)}
    text = F.col(own["text"])
    rows = docs.withColumnsRenamed(own).withColumns({
        "text_key": F.xxhash64(F.coalesce(text, F.lit(""))), "at_doc": F.coalesce(F.col(own["doc_id"]).cast("long"), F.lit(-(1 << 63)))})
    found = found.withColumnRenamed("doc_id", "at_doc")

    @F.pandas_udf("text string, went long, stretches long, sha string")
    def cut(texts: pd.Series, runs: pd.Series, alone: pd.Series, copies: pd.Series) -> pd.DataFrame:
        keep_stores()
        out = []
        for t, r, a, c in zip(texts, runs, alone, copies, strict=True):
            if t is None:
                out.append((None, None, None, None))
                continue
            new, went, stretches = shortened(t, r, a, c)
            out.append((new, went, stretches, hashlib.sha256(new.encode()).hexdigest()))
        return pd.DataFrame(out, columns=["text", "went", "stretches", "sha"])

    joined = rows.join(found.hint("shuffle_hash"), ["text_key", "at_doc"], "left")  # one plan at every size
    # Texts that lose nothing stay in the JVM.
    joined = joined.withColumn("cut", cut(F.when(F.col("copy").isNotNull(), text), "runs", "alone", "copy"))
    if report:
        none = F.lit(0).cast("long")
        return joined.select(
            F.col(own["doc_id"]).alias("doc_id"), F.size(line_ids(text)).cast("long").alias("n_lines"),
            F.coalesce("cut.went", none).alias("n_deleted"), F.coalesce("cut.stretches", none).alias("n_stretches"),
            F.coalesce("cut.sha", F.sha2(F.coalesce(text, F.lit("")), 256)).alias("kept_sha256"))
    now = F.coalesce("cut.text", text)
    return joined.select(*[
        now.alias(c) if c == "text" else F.length(now).cast(docs.schema[c].dataType).alias(c) if c == "n_chars"
        else F.col(own[c]).alias(c) for c in docs.columns])


# The same rows for `run` = 2 in DuckDB: each pair of neighbouring lines against its first place.
ORACLE_SQL = """
with cut_lines as (
  select doc_id, coalesce(text, '') as text, unnest(string_split(coalesce(text, ''), chr(10))) as line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as place
  from documents),
numbered as (
  select *, sum(case when regexp_full_match(line, ' *') then 0 else 1 end) over (partition by doc_id order by place) as nth,
    not regexp_full_match(line, ' *') as is_full
  from cut_lines),
pairs as (
  select doc_id, nth, line, lead(line) over (partition by doc_id order by nth) as follower
  from numbered where is_full),
seen as (
  select doc_id, nth, row_number() over (partition by line, follower order by doc_id, nth) > 1 as again
  from pairs where follower is not null),
gone as (
  select distinct doc_id, nth from (
    select doc_id, nth from seen where again union all select doc_id, nth + 1 as nth from seen where again) both_lines),
marked as (
  select n.*, g.nth is not null as goes from numbered n left join gone g on n.doc_id = g.doc_id and n.nth = g.nth),
runs as (
  select doc_id, count(*) filter (where goes and not coalesce(before, false)) as stretches from (
    select doc_id, goes, lag(goes) over (partition by doc_id order by nth) as before from marked where is_full) ordered_lines
  group by doc_id)
select m.doc_id, cast(count(*) filter (where is_full) as bigint) as n_lines,
  cast(count(*) filter (where is_full and goes) as bigint) as n_deleted,
  cast(coalesce(max(r.stretches), 0) as bigint) as n_stretches,
  sha256(coalesce(string_agg(line, chr(10) order by place) filter (where not goes), '')) as kept_sha256
from marked m left join runs r on m.doc_id = r.doc_id
group by m.doc_id
"""
