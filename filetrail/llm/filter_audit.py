"""Filter interaction audit: what every filter removes at every step of every order, by recursion over filter prefixes."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filetrail.llm.common import stage

Failing = Callable[[Column], Column]
BLANK = " \t\n\x0b\f\r"


def _words(text: Column) -> Column:
    trimmed = F.trim(text, F.lit(BLANK))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t-\\r]+"))


def few_words(text: Column, least: int = 200) -> Column:
    return F.size(_words(text)) < least


def repeats_words(text: Column, percent: int = 50) -> Column:
    words = _words(text)
    return 100 * F.size(F.array_distinct(words)) < percent * F.size(words)


def shouts(text: Column, percent: int = 2) -> Column:
    rest = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "")
    return 100 * (F.length(text) - F.length(rest)) > percent * F.length(text)


def has_marks(text: Column, marks: str = "[#$%&*|]") -> Column:
    return text.rlike(marks)


# Conditions on a text; the letter after these stands for "equals the text of a smaller doc_id".
FILTERS: dict[str, Failing] = {"A": few_words, "B": repeats_words, "C": shouts, "D": has_marks}
COPY = "E"

WALK = """
WITH RECURSIVE walk(prefix, letter, step, applied, mask, failing, gone, alone) AS (
  SELECT CAST('' AS STRING), CAST('' AS STRING), 0, 0, mask, false, false, false FROM {masks}
  UNION ALL
  SELECT concat(w.prefix, w.next), w.next, w.step + 1, w.applied | shiftleft(1, w.pos), c.mask,
         c.mask & shiftleft(1, w.pos) != 0, c.mask & w.applied != 0, c.mask = shiftleft(1, w.pos)
  FROM (SELECT walk.*, posexplode(split('{letters}', '')) AS (pos, next) FROM walk) w JOIN {masks} c ON c.mask = w.mask
  WHERE w.applied & shiftleft(1, w.pos) = 0
)
SELECT * FROM walk WHERE step > 0
"""


def facts(docs: DataFrame, filters: dict[str, Failing], part: str) -> DataFrame:
    """doc_id, part, digest of the text and the bits of the filters that it fails; texts are read here only."""
    text = F.coalesce("text", F.lit(""))
    bits = [F.when(failing(text), 1 << i).otherwise(0) for i, failing in enumerate(filters.values())]
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"), sum(bits, F.lit(0)).alias("mask"))


def cells(facts: DataFrame, labels: DataFrame, copy_bit: int) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the set of filters that they fail, at most 2^filters rows a part.

    A document is a copy when a smaller doc_id has its text. Rows are folded by text and part before anything moves by text, so
    a text that a third of the table has is one row per part; documents without doc_id never meet in a join.
    """
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("long")).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("long")).alias("toxic"))
    named = facts.filter("doc_id is not null").join(marks, "doc_id", "left").groupBy("doc_id", "part", "digest", "mask").agg(
        F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    sums = [F.sum(c).alias(c) for c in ("n", "good", "toxic")]
    texts = stage(named.groupBy("digest", "part", "mask").agg(
        F.min("doc_id").alias("least"), F.min_by(F.struct("n", "good", "toxic"), "doc_id").alias("first"), *sums), "audit-texts")
    smallest = texts.groupBy("digest").agg(F.min("least").alias("smallest"))
    own = F.col("least") == F.col("smallest")
    kinds = [
        F.struct(F.col("mask"), *(F.when(own, F.col(f"first.{c}")).otherwise(0).alias(c) for c in ("n", "good", "toxic"))),
        F.struct(F.col("mask").bitwiseOR(F.lit(copy_bit)).alias("mask"),
                 *((F.col(c) - F.when(own, F.col(f"first.{c}")).otherwise(0)).alias(c) for c in ("n", "good", "toxic"))),
    ]
    known = texts.join(smallest, "digest").select("part", F.explode(F.array(*kinds)).alias("cell")).select("part", "cell.*")
    zero = F.lit(0).cast("long")
    nameless = facts.filter("doc_id is null").groupBy("part", "mask").agg(F.count("*").alias("n")).select(
        "part", "mask", "n", zero.alias("good"), zero.alias("toxic"))
    return known.unionByName(nameless).filter("n > 0").groupBy("part", "mask").agg(*sums)


def walk(masks: DataFrame, letters: str) -> DataFrame:
    """Every prefix of every order with every mask cell: what its last filter does to documents of that cell.

    One recursive common table expression. A level extends each prefix with each unused letter, joins the mask cells and carries
    the bits applied so far; its rows are that step's outcomes: `failing` the last filter, `gone` before it, failing it `alone`.
    For five filters 325 prefixes times at most 32 cells, whatever the data.
    """
    if not letters.isalnum() or len(set(letters)) != len(letters):
        raise ValueError("filters are named by different letters or digits")
    return masks.sparkSession.sql(WALK.replace("{letters}", letters), masks=masks)


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Failing] | None = None, part: str = "source") -> DataFrame:
    """Effects of all filters in all their orders, per part.

    `filters` maps one-letter names to conditions on the text that fail a document; "E", a text that some smaller doc_id has, table-wide
    and removed or not, comes last. Returns one row per part (values of that column; null is the empty string), filter_order and step with
    kept (after the step), removed (by it), redundant (failing its filter, removed earlier), unique_fails (failing its filter only),
    good_lost and toxic_lost (removed by it with such a label) and shapley (removed by that filter, summed over all orders).

    Null texts are empty. A null doc_id never fails "E", makes no other row fail and has no label; rows that share a doc_id are documents
    of their own, and neither is the copy of the other. A doc_id with several labels has each that one of them gives. An empty
    table gives no row; other columns are ignored. Counts are exact; texts are compared by SHA-256.
    """
    filters = FILTERS if filters is None else filters
    letters = "".join(filters) + COPY
    last = len(letters)
    counted = stage(cells(stage(facts(docs, filters, part), "audit-facts"), labels, 1 << (last - 1)), "audit-cells")
    # At most 325 prefixes times 32 masks for five filters, so their size does not depend on the data.
    outcomes = stage(walk(counted.select("mask").distinct(), letters), "audit-walk")
    reach, failing = ~F.col("gone"), F.col("failing")

    def total(count: str, when: Column) -> Column:
        return F.sum(F.when(when, F.col(count)).otherwise(0))

    steps = counted.join(F.broadcast(outcomes), "mask").groupBy("part", "prefix", "letter", "step").agg(
        total("n", reach & ~failing).alias("kept"), total("n", reach & failing).alias("removed"),
        total("n", ~reach & failing).alias("redundant"), total("n", F.col("alone")).alias("unique_fails"),
        total("good", reach & failing).alias("good_lost"), total("toxic", reach & failing).alias("toxic_lost"))
    # A prefix of s letters begins (last - s)! orders.
    orders = F.element_at(F.array(*(F.lit(math.factorial(last - s)) for s in range(1, last + 1))), F.col("step"))
    shapley = steps.groupBy("part", "letter").agg(F.sum(F.col("removed") * orders).alias("shapley"))
    whole = outcomes.filter(F.col("step") == last).select(F.col("prefix").alias("filter_order")).distinct().select(
        "filter_order", F.explode(F.sequence(F.lit(1), F.lit(last))).alias("at")).select(
        "filter_order", F.expr("substring(filter_order, 1, at)").alias("prefix"))
    return steps.join(shapley, ["part", "letter"]).join(F.broadcast(whole), "prefix").select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


ORACLE_SQL = r"""
WITH RECURSIVE body AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body FROM documents
), words AS (
  SELECT *, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS words FROM body
), marks AS (
  SELECT doc_id, max(coalesce(quality = 1, false)::INT) AS good, max(coalesce(toxic = 1, false)::INT) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), fails AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    concat(CASE WHEN len(words) < 200 THEN 'A' ELSE '' END,
      CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END,
      CASE WHEN 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 2 * length(body) THEN 'C' ELSE '' END,
      CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 'D' ELSE '' END,
      CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY body) THEN 'E' ELSE '' END) AS failing
  FROM words LEFT JOIN marks USING (doc_id)
), orders(filter_order) AS (
  SELECT '' UNION ALL
  SELECT concat(filter_order, letter) FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) AS l(letter)
  WHERE NOT contains(filter_order, letter)
), steps AS (
  SELECT filter_order, step, substring(filter_order, step, 1) AS letter, substring(filter_order, 1, step - 1) AS before
  FROM orders, range(1, 6) AS r(step) WHERE length(filter_order) = 5
), cells AS (
  SELECT part, failing, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY ALL
), judged AS (
  SELECT *, contains(failing, letter) AS hit,
    before <> '' AND length(translate(failing, before, '')) < length(failing) AS gone FROM cells, steps
), counted AS (
  SELECT part, filter_order, step::INT AS step, letter,
    sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN hit AND gone THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN failing = letter THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM judged GROUP BY part, filter_order, step, letter
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM counted
"""
