"""Which earlier file of its session a file was derived from.

The winner of a search is the candidate with the smallest (distance, candidate order, fingerprint rank). A
re-upload replaces the earlier upload of the same file, so an upload is a candidate from just after its
arrival until the next upload of its file (inclusive), and its order is its own arrival.

The search never looks at pairs of uploads:

1. Per fingerprint value, the *head* is the earliest candidate carrying it. The head only ever moves
   forward, so it is a step function of time, found with ordered scans.
2. An upload whose own value already has a head is settled at distance 0. What is left is at most one upload
   per distinct value, whatever the number of copies.
3. The rest search the distinct values, nearest tier first. An upload settled in a tier cannot do better in
   a later one, so dense clusters are settled by the very selective small-radius layouts.
4. The heads of the values found are looked up at the arrival of the searching upload.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filetrail.operators.hamming import near_values
from filetrail.operators.ordered import BLOCK_ROWS, exclusive_prefix, next_value
from filetrail.session import stage

# Thresholds of the two passes.
MATCH_DISTANCE = 10
MIN_GOOD_FEATURES = 25
# Radii searched before the full radius, and the number of values in a session from which that pays.
NEAR_TIERS = (3,)
TIER_VALUES = 50_000


def prior_candidates(
    uploads: DataFrame, session: str = "session_id", file: str = "file_id", arrival: str = "arrival",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Candidate life of every upload, and how many candidates it saw itself.

    A later upload t of the session sees this one exactly if arrival < t <= replaced_at (no end when NULL).
    That says for all pairs of uploads who is whose candidate, in one row per upload.
    """
    lives = next_value(uploads.select(session, file, arrival), [session, file], arrival, "replaced_at", block_rows)
    firsts = uploads.groupBy(session, file).agg(F.min(arrival).alias(arrival)).withColumn("is_new", F.lit(1))
    marked = lives.join(firsts, [session, file, arrival], "left").withColumn(
        "is_new", F.coalesce("is_new", F.lit(0)).cast("bigint")
    )
    return exclusive_prefix(
        marked, [session], [F.col(arrival)], F.col("is_new"), "candidates", how="sum", block_rows=block_rows
    ).drop("is_new")


def _heads(carriers: DataFrame, keys: list[str], block_rows: int) -> DataFrame:
    """Steps of the head function per value: from just after `start`, the head is upload `head`."""
    scanned = exclusive_prefix(
        carriers.withColumn("ends", F.coalesce("replaced_at", F.lit((1 << 63) - 1))),
        keys, [F.col("arrival")], F.col("ends"), "others_end", block_rows=block_rows,
    )
    return scanned.filter(F.col("others_end").isNull() | (F.col("others_end") < F.col("ends"))).select(
        *keys,
        F.greatest("arrival", "others_end").alias("start"),
        F.struct(F.col("arrival").alias("order"), F.col("file_id").alias("parent_file_id")).alias("head"),
    )


def _heads_at(heads: DataFrame, moments: DataFrame, keys: list[str], at: str, block_rows: int) -> DataFrame:
    """Add `head` to every moment: the head of its value just before `at`; moments without one are dropped."""
    steps = heads.withColumnRenamed("start", at).withColumn("step", F.lit(1))
    together = moments.withColumn("step", F.lit(0)).unionByName(steps, allowMissingColumns=True)
    # Starts and heads rise together, so the latest head before a moment is also the largest one.
    found = exclusive_prefix(
        together, keys, [F.col(at), F.col("step")], F.col("head"), "found", block_rows=block_rows
    )
    return (
        found.filter((F.col("step") == 0) & F.col("found").isNotNull())
        .drop("head", "step").withColumnRenamed("found", "head").select(*moments.columns, "head")
    )


def _settle(found: DataFrame, ranks: Column) -> DataFrame:
    """Per upload the smallest (distance, candidate order, rank)."""
    choice = F.struct("distance", F.col("head.order").alias("order"), "rank", "head.parent_file_id")
    best = found.groupBy("session_id", "arrival").agg(F.min(choice).alias("best"))
    return best.select(
        "session_id", "arrival",
        F.col("best.parent_file_id").alias("parent_file_id"),
        F.col("best.order").alias("parent_order"),
        F.col("best.distance").cast("int").alias("metric"),
        F.get(ranks, F.col("best.rank")).alias("match_type"),
    )


def hash_matches(
    uploads: DataFrame, hashes: list[str], radius: int = MATCH_DISTANCE, searching: str | None = None,
    tiers: tuple[int, ...] | None = None, bands: int | None = None, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Best fingerprint parent per upload: session_id, arrival, parent_file_id, parent_order, metric, match_type.

    `uploads` has session_id, arrival (unique in a session), file_id and bigint fingerprint columns, listed in
    `hashes` by rank. `searching` names a boolean column; uploads without it are candidates only. `uploads` is read
    several times, so it should be a table. `tiers` fixes the radii tried first; by default they depend on the
    largest session.
    """
    slots = F.array(*[F.struct(F.lit(i).alias("rank"), F.col(h).alias("h")) for i, h in enumerate(hashes)])
    keys, upload_key = ["session_id", "rank", "h"], ["session_id", "arrival"]

    def carriers(rows: DataFrame, *kept: str) -> DataFrame:
        listed = rows.withColumn("slot", F.explode(slots)).filter("slot.h is not null")
        return listed.select("session_id", "arrival", *kept, "slot.rank", "slot.h")

    lean = uploads.select("session_id", "arrival", "file_id", *hashes)
    lives = next_value(lean, ["session_id", "file_id"], "arrival", "replaced_at", block_rows)
    heads = stage(_heads(carriers(lives, "file_id", "replaced_at"), keys, block_rows), "heads")
    ranks = F.array(*[F.lit(h) for h in hashes])
    children = carriers(uploads.filter(F.col(searching)) if searching else uploads)
    same = _heads_at(heads, children, keys, "arrival", block_rows).withColumn("distance", F.lit(0))
    settled = stage(_settle(same, ranks), "settled-0")
    results = [settled]
    values = heads.groupBy(*keys).agg(F.min("head.order").alias("first_arrival"))
    largest = values.groupBy("session_id", "rank").count().agg(F.max("count")).first()[0] or 0
    if tiers is None:
        tiers = NEAR_TIERS if largest > TIER_VALUES else ()
    done = 0
    for reach in [t for t in tiers if t < radius] + [radius] * (radius > 0):
        children = children.join(settled, upload_key, "left_anti")
        pairs = near_values(
            children, values, ["session_id", "rank"], reach, before="arrival", bands=bands, at_least=done + 1,
            largest=largest, best=True,
        )
        # A value seen before an upload has a head then, so only an upload's nearest values can win.
        sought = F.struct("rank", F.col("near").alias("h"))
        nearest = pairs.groupBy(*upload_key, "distance").agg(F.collect_set(sought).alias("sought")).groupBy(*upload_key).agg(
            F.min("distance").alias("distance"), F.min_by("sought", "distance").alias("sought"))
        moments = nearest.select(*upload_key, F.explode("sought").alias("s"), "distance").select(
            *upload_key, "s.rank", "s.h", "distance")
        settled = stage(_settle(_heads_at(heads, moments, keys, "arrival", block_rows), ranks), f"settled-{reach}")
        results.append(settled)
        done = reach
    matched = results[0]
    for more in results[1:]:
        matched = matched.unionByName(more)
    return matched


def best_match(
    uploads: DataFrame, hashes: list[str], radius: int = MATCH_DISTANCE, searching: str | None = None,
    features: DataFrame | None = None, min_good: int = MIN_GOOD_FEATURES, **options,
) -> DataFrame:
    """Two passes: fingerprints first; only uploads without a fingerprint parent go to local features."""
    by_hash = hash_matches(uploads, hashes, radius, searching, **options)
    if features is None:
        return by_hash
    from filetrail.operators.features import local_feature_match

    by_hash = stage(by_hash, "by-hash")
    asking = uploads.filter(F.col(searching)) if searching else uploads
    asking = asking.select("session_id", "arrival").join(by_hash, ["session_id", "arrival"], "left_anti")
    by_feature = local_feature_match(features, uploads, asking, min_good=min_good)
    return by_hash.unionByName(by_feature)


def attach_parent(uploads: DataFrame, matches: DataFrame, parent_columns: list[str]) -> DataFrame:
    """Matches joined to the child's row and to `parent_columns` of the parent's upload, as parent_<name>."""
    parents = uploads.select(
        "session_id", F.col("arrival").alias("parent_order"),
        *[F.col(c).alias(f"parent_{c}") for c in parent_columns],
    )
    return uploads.join(matches, ["session_id", "arrival"], "left").join(
        parents, ["session_id", "parent_order"], "left"
    )


def exact_duplicates(uploads: DataFrame, session: str = "session_id", sha: str = "sha256") -> DataFrame:
    """Content seen more than once in a session, with its number of uploads and its first and last one."""
    return (
        uploads.groupBy(session, sha)
        .agg(F.count(F.lit(1)).alias("copies"), F.min("arrival").alias("first_arrival"),
             F.max("arrival").alias("last_arrival"))
        .filter("copies > 1")
    )
