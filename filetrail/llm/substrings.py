"""Exact substring dedup: column-wise construction of a collection's Burrows-Wheeler transform and common prefixes."""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filetrail.llm.common import bytes_of, keep_stores, lean, stage, worker_store
from filetrail.llm.shingles import mix

GRAM = 50  # bytes of an anchor
STEP_BYTES = 1 << 18  # of text that a worker looks at together: some ten arrays of eight bytes each
BUCKET_BYTES = 12 << 20  # of text per bucket of anchors
COLUMNS_IN_MEMORY = 64 << 20
HEAVY_TEXTS = 100_000
HOT_CONTEXTS = 20_000  # different contexts of one anchor that are compared in one task; more are compared window by window
SAMPLE_ONE_IN = 1024  # texts looked at for anchors whose contexts are dealt over buckets
HOT_IN_SAMPLE = 64
SPOT_ROWS = 4096
OUTSIDE = np.uint16(256)  # a symbol that equals nothing, itself included
BASE = 0x9E3779B97F4A7C15 | 1


# --- anchors ----------------------------------------------------------------------------------------------------

def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    store = worker_store("powers")
    if len(store.get("up", ())) < n:
        one = np.ones(1, np.uint64)
        store["up"] = np.concatenate([one, np.cumprod(np.full(n, BASE, np.uint64))])
        store["down"] = np.concatenate([one, np.cumprod(np.full(n, pow(BASE, -1, 1 << 64), np.uint64))])
        store["letter"] = mix(np.arange(256, dtype=np.uint64))
    return store["up"], store["down"]


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """`pick` (minimum or maximum) over each run of `width` values."""
    size, reach = len(x) - width + 1, 1
    while 2 * reach <= width:
        x = pick(x[:-reach], x[reach:])
        reach *= 2
    return pick(x[:size], x[width - reach:width - reach + size])


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, hash and context hash of the anchors of some texts.

    A text's anchors are the grams of least hash in any of its windows of `length` bytes, ties included. Equal windows hold
    their first anchor at the same place, so all copies of a window meet under one anchor, in the same column of its
    context: the bytes from `length - GRAM` before it to `length` after it, as far as the text goes.
    """
    n = len(raw)
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    if n < length:
        return none
    up, down = _powers(n + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(worker_store("powers")["letter"][raw] * up[:n])])
    grams = mix((sums[GRAM:] - sums[:-GRAM]) * down[:n - GRAM + 1])
    width = length - GRAM + 1
    least = _slide(grams, width, np.minimum)
    crossing = np.zeros(n + 1, np.int64)
    for cut in offsets[1:-1].tolist():
        crossing[max(0, cut - length + 1)] += 1
        crossing[cut] -= 1
    least[np.cumsum(crossing)[:len(least)] > 0] = 0
    edge = np.zeros(width - 1, np.uint64)
    most = _slide(np.concatenate([edge, least, edge]), width, np.maximum)
    at = np.flatnonzero((most == grams) & (most > 0))
    text = np.searchsorted(offsets, at, side="right") - 1
    left = np.maximum(offsets[text], at - (length - GRAM))
    right = np.minimum(offsets[text + 1], at + length)
    context = mix((sums[right] - sums[left]) * down[left] + mix(((at - left) * 1000 + right - at).astype(np.uint64)))
    return at, grams[at], context


def _units(batch: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int, int, int]]:
    """Pieces of a batch for `anchors`: rows, bytes, offsets, what to add to positions, range of positions that count.

    Texts of ordinary size go together; a very long one is cut into overlapping slices.
    """
    raw, offsets = bytes_of(batch.column("text"))
    start, rows = 0, batch.num_rows
    while start < rows:
        if offsets[start + 1] - offsets[start] > STEP_BYTES:
            a, b = int(offsets[start]), int(offsets[start + 1])
            for core in range(0, b - a, STEP_BYTES):
                lo, hi = max(0, core - 2 * length), min(b - a, core + STEP_BYTES + 2 * length)
                yield np.array([start]), raw[a + lo:a + hi], np.array([0, hi - lo]), lo, core, core + STEP_BYTES
            start += 1
            continue
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + STEP_BYTES, side="right")) - 1)
        long = np.flatnonzero(np.diff(offsets[start:end + 1]) > STEP_BYTES)
        end = start + int(long[0]) if len(long) else end
        yield np.arange(start, end), raw[offsets[start]:offsets[end]], offsets[start:end + 1] - offsets[start], 0, 0, 1 << 62
        start = end


# --- packed chunks to buckets -------------------------------------------------------------------------------------

def _chunks(bucket: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row per bucket with its entries of each column as bytes."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(bucket)) if len(bucket) else starts
    out = [pa.array(bucket[starts].astype(np.int32))]
    for values in columns.values():
        values = np.ascontiguousarray(values[order])
        out.append(pa.array([values[i:j].tobytes() for i, j in zip(starts, ends, strict=True)], pa.binary()))
    return pa.RecordBatch.from_arrays(out, names=["bucket", *columns])


def _whole_buckets(batches: Iterator[pa.RecordBatch], types: list) -> Iterator[list[np.ndarray]]:
    """The entries of one bucket after another, from chunks in bucket order."""
    held, current = [], None
    for batch in batches:
        for bucket, *parts in zip(*(batch.column(i).to_pylist() for i in range(len(types) + 1)), strict=True):
            if bucket != current and held:
                yield [np.concatenate(c) for c in zip(*held, strict=True)]
                held = []
            current = bucket
            held.append([np.frombuffer(p, t) for p, t in zip(parts, types, strict=True)])
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


FULL, ASK, SHOW, HOT = 0, 1, 2, 3
ALONE, SEVERAL, TOLD = 1, 2, 3  # places of a context in one piece of the input: one, the first of several, another of them
ENTRY = [np.uint64, np.uint64, np.int64, np.int64, np.uint8]


def _met(entries: list[np.ndarray], hot: np.ndarray) -> pa.RecordBatch:
    """What one bucket's anchors say: (text, at, what).

    FULL: another place has the same context. Where contexts of one anchor differ, one place of each context goes on to
    be compared: to learn what it shares (ASK), or, where that is known, only for the others' sake (SHOW). Of anchors with very many
    contexts (those in `hot`, whose contexts lie in several buckets, and what turns out so here) it goes on to be compared by windows (HOT).
    """
    told = entries[4] == TOLD
    said_text, said_at = entries[2][told], entries[3][told]
    gram, context, text, at, count = (x[~told] for x in entries)
    order = np.lexsort((at, text, context, gram))
    gram, context, text, at, count = (x[order] for x in (gram, context, text, at, count))
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (context[1:] != context[:-1]) | (text[1:] != text[:-1]) | (at[1:] != at[:-1])
    many = np.maximum.reduceat(count, np.flatnonzero(new)) if len(gram) else count
    gram, context, text, at = (x[new] for x in (gram, context, text, at))
    if not len(gram):
        what = np.full(len(said_at), FULL, np.int32)
        return pa.RecordBatch.from_arrays([pa.array(said_text), pa.array(said_at), pa.array(what)], names=["text_key", "at", "what"])
    first = np.append(True, (gram[1:] != gram[:-1]) | (context[1:] != context[:-1]))
    klass = np.cumsum(first) - 1
    starts = np.flatnonzero(first)
    full = (np.bincount(klass) > 1) | (np.maximum.reduceat(many, starts) == SEVERAL)
    own = np.append(True, gram[starts][1:] != gram[starts][:-1])
    contexts = np.bincount(np.cumsum(own) - 1)
    mixed = (contexts > 1)[np.cumsum(own) - 1]
    many = (contexts > HOT_CONTEXTS)[np.cumsum(own) - 1] | np.isin(gram[starts], hot)
    mixed &= ~many
    rows = [np.flatnonzero(full[klass]), starts[mixed & ~full], starts[mixed & full], starts[many]]
    what = np.concatenate([np.full(len(r), w, np.int32) for r, w in zip(rows, (FULL, ASK, SHOW, HOT), strict=True)])
    what = np.concatenate([what, np.full(len(said_at), FULL, np.int32)])
    rows = np.concatenate(rows)
    return pa.RecordBatch.from_arrays([
        pa.array(np.concatenate([text[rows], said_text])), pa.array(np.concatenate([at[rows], said_at])), pa.array(what),
    ], names=["text_key", "at", "what"])


def _hot_grams(docs: DataFrame, length: int, speakers: dict[int, int | None]) -> np.ndarray:
    """Sorted hashes of anchors that are frequent in a sample of texts. Only where entries meet depends on it, not the results."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = batch.column("text_key").to_pylist(), batch.column("doc_id").to_pylist()
            speaks = np.array([speakers.get(k, d) == d for k, d in zip(keys, ids, strict=True)], bool)
            for rows, raw, offsets, _, _, _ in _units(batch, length):
                at, gram, context = anchors(raw, offsets, length)
                said = speaks[rows[np.searchsorted(offsets, at, side="right") - 1]]
                one = np.unique(np.stack([gram[said], context[said]]), axis=1)[0]
                yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64))], names=["gram"])

    some = docs.filter(F.pmod("text_key", F.lit(SAMPLE_ONE_IN)) == 0)
    found = some.mapInArrow(lean(find, "powers"), "gram long").groupBy("gram").count().filter(F.col("count") >= HOT_IN_SAMPLE)
    return np.sort(np.array([r["gram"] for r in found.collect()], np.int64).view(np.uint64))


def _anchor_rows(docs: DataFrame, length: int, speakers: dict[int, int | None], buckets: int) -> DataFrame:
    """(text_key, at, what) of all anchors that several places have."""
    hot = _hot_grams(docs, length, speakers)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = batch.column("text_key").to_numpy(), batch.column("doc_id").to_pylist()
            speaks = np.array([speakers.get(k, d) == d for k, d in zip(keys.tolist(), ids, strict=True)], bool)
            for rows, raw, offsets, shift, low, high in _units(batch, length):
                at, gram, context = anchors(raw, offsets, length)
                text = np.searchsorted(offsets, at, side="right") - 1
                place = at - offsets[text] + shift
                keep = speaks[rows[text]] & (place >= low) & (place < high) if len(at) else np.zeros(0, bool)
                entries = [gram[keep], context[keep], keys[rows[text[keep]]], place[keep]]
                order = np.lexsort((entries[3], entries[2], entries[1], entries[0]))
                entries = [e[order] for e in entries]
                gram, context, text, place = entries
                if not len(gram):
                    continue
                # Places of one context in this piece: all are told apart here, one goes on for them.
                first = np.append(True, (gram[1:] != gram[:-1]) | (context[1:] != context[:-1]))
                apart = np.append(False, ~first[1:] & ((text[1:] != text[:-1]) | (place[1:] != place[:-1])))
                starts = np.flatnonzero(first)
                several = np.add.reduceat(apart.astype(np.int64), starts) > 0
                klass = np.cumsum(first) - 1
                send = first | (several[klass] & apart)
                count = np.where(several[klass], np.where(first, SEVERAL, TOLD), ALONE).astype(np.uint8)
                by = np.where(count == TOLD, mix(text.view(np.uint64) ^ gram), mix(gram))  # an anchor's own hash is always small
                by = np.where((count != TOLD) & np.isin(gram, hot), mix(gram ^ mix(context)), by)
                bucket = (((by >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
                yield _chunks(bucket[send], {
                    "gram": gram[send], "context": context[send], "text": text[send], "at": place[send], "count": count[send]})

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for entries in _whole_buckets(batches, ENTRY):
            yield _met(entries, hot)

    chunks = docs.mapInArrow(lean(find, "powers"), "bucket int, gram binary, context binary, text binary, at binary, count binary")
    met = chunks.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return stage(met.mapInArrow(lean(meet, "powers"), "text_key long, at long, what int"), "repeats-anchors")


# --- column-wise construction --------------------------------------------------------------------------------------

def _range_min(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minimum of values[low..high], both ends included, for many ranges."""
    out = values[high].copy()
    wide = np.flatnonzero(low < high)
    if not len(wide):
        return out
    a, b = low[wide], high[wide]
    level = np.floor(np.log2(b - a + 1)).astype(np.int64)
    found = np.empty(len(wide), values.dtype)
    table = values
    for k in range(int(level.max()) + 1):
        here = level == k
        found[here] = np.minimum(table[a[here]], table[b[here] - (1 << k) + 1])
        table = np.minimum(table[:-(1 << k)], table[1 << k:]) if len(table) > 1 << k else table
    out[wide] = found
    return out


def repeated_columns(contexts: np.ndarray, length: int) -> np.ndarray:
    """For aligned strings (one row each, symbols up to `OUTSIDE`), where a window starts that another string has there too.

    Strings are built up from the last column: each round inserts one symbol in front of every string's suffix. Kept are the order of
    the suffixes and, between neighbours, the column where they first differ. The transform's next column is the new symbols
    in that order; sorting it stably gives the next order, and neighbours with one symbol differ where the suffixes between
    them first did. Columns lie one after another in an external file (memory up to a bound) and are read once each.
    """
    count, columns = contexts.shape
    out = np.zeros((columns - length + 1, count), bool)
    order = np.arange(count)
    differ = np.full(count, columns, np.int64)
    differ[0] = 0
    with tempfile.SpooledTemporaryFile(max_size=COLUMNS_IN_MEMORY) as file:
        for column in range(columns - 1, -1, -1):
            file.write(np.ascontiguousarray(contexts[:, column], np.uint16).tobytes())
        file.seek(0)
        for column in range(columns - 1, -1, -1):
            transform = np.frombuffer(file.read(2 * count), np.uint16)[order]
            moved = np.argsort(transform, kind="stable")
            symbols = transform[moved]
            same = np.append(False, (symbols[1:] == symbols[:-1]) & (symbols[1:] != OUTSIDE))
            joined = np.flatnonzero(same)
            after = np.full(count, column, np.int64)
            after[joined] = _range_min(differ, moved[joined - 1] + 1, moved[joined])
            order, differ = order[moved], after
            if column <= columns - length:
                equal = differ >= column + length
                either = equal.copy()
                either[:-1] |= equal[1:]
                out[column, order] = either
    return out


def _asked(texts: DataFrame, length: int, buckets: int) -> DataFrame:
    """(text_key, low, high): byte ranges of asked contexts that lie in repeated windows."""
    before = length - GRAM
    columns = before + length

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("text_key").to_pylist()
            for row in range(batch.num_rows):
                at = np.array(batch.column("places")[row].as_py(), np.int64)
                if not len(at):
                    continue
                asks, at = at % 2 == 1, at // 2
                raw = np.frombuffer(batch.column("text")[row].as_py().encode(), np.uint8)
                for some in np.array_split(np.arange(len(at)), -(-len(at) // 4096)):
                    spots = at[some][:, None] + np.arange(-before, length)
                    inside = (spots >= 0) & (spots < len(raw))
                    symbols = np.where(inside, raw[np.where(inside, spots, 0)], OUTSIDE).astype(np.uint16)
                    weights = mix(np.arange(GRAM, dtype=np.uint64))
                    gram = mix((mix(symbols[:, before:before + GRAM].astype(np.uint64)) * weights).sum(1, dtype=np.uint64))
                    bucket = (((gram >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
                    # Bytes outside the text are told by the place and the text's length.
                    yield _chunks(bucket, {
                        "symbols": symbols.astype(np.uint8), "text": np.full(len(some), keys[row]), "at": at[some],
                        "size": np.full(len(some), len(raw)), "ask": asks[some].astype(np.uint8)})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for symbols, text, at, size, ask in _whole_buckets(batches, [np.uint8, np.int64, np.int64, np.int64, np.uint8]):
            symbols = symbols.reshape(-1, columns)
            _, one = np.unique(np.stack([text, at]), axis=1, return_index=True)  # repeated rows come several times
            symbols, text, at, size, ask = (x[one] for x in (symbols, text, at, size, ask))
            whole = symbols.astype(np.uint16)
            for i in range(0, len(at), SPOT_ROWS):
                spots = at[i:i + SPOT_ROWS, None] + np.arange(-before, length)
                whole[i:i + SPOT_ROWS][(spots < 0) | (spots >= size[i:i + SPOT_ROWS, None])] = OUTSIDE
            starts = repeated_columns(whole, length)
            starts = starts.T & (ask == 1)[:, None]
            edge = np.zeros((len(at), 1), np.int8)
            turns = np.diff(np.concatenate([edge, starts.astype(np.int8), edge], axis=1), axis=1)
            row, low = np.nonzero(turns == 1)
            _, high = np.nonzero(turns == -1)
            begin = at[row] - before
            yield pa.RecordBatch.from_arrays(
                [pa.array(text[row]), pa.array(begin + low), pa.array(begin + high - 1 + length)], names=["text_key", "low", "high"])

    chunks = texts.select("text_key", "text", "places").mapInArrow(
        lean(cut, "powers"), "bucket int, symbols binary, text binary, at binary, size binary, ask binary")
    return chunks.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(
        lean(compare, "powers"), "text_key long, low long, high long")


def _windows(texts: DataFrame, length: int) -> DataFrame:
    """(text_key, low, high): windows around hot places (one row a text) that start at another such place, too.

    All windows that hold the anchor are hashed and counted on Spark, so no task holds the contexts of one anchor. Each context
    has one place here, and copies of a window have the same anchors: a window that is there once has no copy elsewhere.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up, down = _powers(2 * STEP_BYTES + length)
        letter = worker_store("powers")["letter"]
        for batch in batches:
            keys = batch.column("text_key").to_pylist()
            for row in range(batch.num_rows):
                at = np.array(batch.column("hot")[row].as_py(), np.int64)
                if not len(at):
                    continue
                raw = np.frombuffer(batch.column("text")[row].as_py().encode(), np.uint8)
                turns = np.zeros(len(raw) + 1, np.int32)
                np.add.at(turns, np.maximum(at - (length - GRAM), 0), 1)
                np.add.at(turns, at + 1, -1)
                starts = np.flatnonzero(np.cumsum(turns[:max(0, len(raw) - length + 1)]) > 0)
                for step in np.split(starts, np.searchsorted(starts, np.arange(STEP_BYTES, len(raw), STEP_BYTES))):
                    if not len(step):
                        continue
                    part = raw[step[0]:step[-1] + length]
                    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letter[part] * up[:len(part)])])
                    i = step - step[0]
                    window = mix((sums[i + length] - sums[i]) * down[i])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(window.view(np.int64)), pa.array(np.full(len(i), keys[row])), pa.array(step)],
                        names=["window", "text_key", "low"])

    found = stage(texts.select("text_key", "text", "hot").mapInArrow(lean(cut, "powers"), "window long, text_key long, low long"), "repeats-windows")
    several = found.groupBy("window").count().filter("count > 1").select("window").hint("merge")
    return found.join(several, "window", "left_semi").select("text_key", "low", (F.col("low") + length).alias("high"))


# --- the operator ------------------------------------------------------------------------------------------------

def spans_of(texts: DataFrame, ranges: DataFrame) -> DataFrame:
    """(text_key, text, spans): the union of each text's ranges, as sorted disjoint [low, high) byte ranges."""
    gathered = ranges.groupBy("text_key").agg(F.array_sort(F.collect_list(F.struct("low", "high"))).alias("ranges"))
    merged = F.aggregate(
        "ranges", F.expr("cast(array() as array<struct<low:bigint,high:bigint>>)"),
        lambda out, r: F.when((F.size(out) > 0) & (F.element_at(out, -1)["high"] >= r["low"]), F.concat(
            F.slice(out, 1, F.size(out) - 1),
            F.array(F.struct(F.element_at(out, -1)["low"].alias("low"), F.greatest(F.element_at(out, -1)["high"], r["high"]).alias("high"))),
        )).otherwise(F.concat(out, F.array(r))))
    # Contexts may reach past the end of a text; only the last span can.
    whole = F.transform("spans", lambda s: F.struct(
        s["low"].alias("low"), F.least(s["high"], F.octet_length("text").cast("long")).alias("high")))
    return texts.select("text_key", "text").join(gathered.select("text_key", merged.alias("spans")), "text_key").withColumn("spans", whole)


def repeats(docs: DataFrame, length: int = 200) -> tuple[DataFrame, DataFrame]:
    """Which bytes of whole texts lie in a `length`-byte string that also starts somewhere else, in any document.

    Returns two tables: one row per document (doc_id, text_key, n_bytes, sha, copies: documents with this text) and, for texts
    with a single document or length of repeats found by comparison, (text_key, text, spans). A text of `length` bytes or more
    that several documents have is repeated as a whole and needs no spans.

    1. Every text sends its anchors to buckets; places that have an anchor to themselves are done with. Places with an equal
       context are repeated over all of it. A text with very many copies speaks once (a list of at most `HEAVY_TEXTS`).
    2. Where contexts of an anchor differ, one of each goes through the column-wise construction, bucket by bucket. Where they are more
       than `HOT_CONTEXTS`, their windows are counted on Spark instead.
    3. Ranges are joined to spans per text. A bucket's memory is that of a few MB of text, and of `HOT_CONTEXTS` contexts of an
       anchor at most where it compares; equal contexts within a piece of input leave it once, so copies do not pile up.
    """
    text = F.coalesce("text", F.lit(""))
    spark = docs.sparkSession
    keyed = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    facts = stage(keyed.select(
        "doc_id", "text_key", F.xxhash64("text", F.lit(1)).alias("check"), F.octet_length("text").cast("long").alias("n_bytes"),
        F.sha2("text", 256).alias("sha")), "repeats-facts")
    classes = facts.groupBy("text_key", "check").agg(F.count("*").alias("copies"), F.min("doc_id").alias("speaker"))
    totals = facts.agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("rows")).first()
    heavy = classes.filter(F.col("copies") > max(64, totals["rows"] // HEAVY_TEXTS)).select("text_key", "speaker").collect()
    speakers = {r["text_key"]: r["speaker"] for r in heavy}
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(2 * width, (totals["bytes"] or 0) // BUCKET_BYTES)
    told = _anchor_rows(keyed, length, speakers, buckets)
    places = told.groupBy("text_key").agg(
        F.collect_list(F.when(F.col("what").isin(ASK, SHOW), F.col("at") * 2 + (F.col("what") == ASK).cast("long"))).alias("places"),
        F.collect_list(F.when(F.col("what") == HOT, F.col("at"))).alias("hot"))
    one = places.join(classes, "text_key").select("text_key", F.col("speaker").alias("doc_id"), "places", "hot")
    texts = stage(keyed.join(one.hint("shuffle_hash"), [
        keyed["text_key"] == one["text_key"], keyed["doc_id"].eqNullSafe(one["doc_id"])]).select(
        keyed["text_key"], keyed["text"], "places", "hot").dropDuplicates(["text_key"]), "repeats-texts")
    full = told.filter(F.col("what") == FULL).select(
        "text_key", F.greatest(F.col("at") - (length - GRAM), F.lit(0)).alias("low"), (F.col("at") + length).alias("high"))
    ranges = full.unionByName(_asked(texts, length, buckets))
    hot = texts.filter(F.size("hot") > 0)
    if not hot.isEmpty():
        ranges = ranges.unionByName(_windows(hot, length))
    ranges = stage(ranges, "repeats-ranges")
    return facts.join(classes.select("text_key", "check", "copies"), ["text_key", "check"]).drop("check"), spans_of(texts, ranges)


def _kept(data: bytes, spans: list) -> bytes:
    out, at = [], 0
    for span in spans:
        out.append(data[at:span["low"]])
        at = span["high"]
    return b"".join([*out, data[at:]])


def removal_report(docs: DataFrame, length: int = 200) -> DataFrame:
    """Per document doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 of the remaining bytes.

    Removed is each byte of a `length`-byte string that starts elsewhere too, judged on the input. Null texts are empty; texts shorter
    than `length` keep everything; nulls and repeats in doc_id and repeated rows are documents of their own (repeated rows are
    copies of each other); other columns are ignored; an empty table gives no row.
    """
    rows, spans = repeats(docs, length)

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, shas = [], []
            for data, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                removed.append(sum(s["high"] - s["low"] for s in found))
                shas.append(hashlib.sha256(_kept(data.encode(), found)).hexdigest())
            counts = [len(s) for s in batch.column("spans").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("text_key"), pa.array(removed, pa.int64()), pa.array(counts, pa.int64()), pa.array(shas, pa.string())],
                names=["text_key", "removed", "runs", "left_sha"])

    found = spans.mapInArrow(lean(report, "powers"), "text_key long, removed long, runs long, left_sha string")
    copied = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    empty = hashlib.sha256(b"").hexdigest()
    return rows.join(found, "text_key", "left").select(
        "doc_id", "n_bytes",
        F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(copied, F.lit(1)).otherwise(F.coalesce("runs", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copied, F.lit(empty)).otherwise(F.coalesce("left_sha", "sha")).alias("kept_sha256"))


def remove_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """The same documents without repeated bytes in `text`; characters that are repeated only in part stay whole.

    All columns and rows stay. Texts left empty stay as empty texts, null ones as null. A column `n_chars` gets the new length.
    """
    rows, spans = repeats(docs, length)
    copied = rows.filter((F.col("copies") > 1) & (F.col("n_bytes") >= length)).select("text_key").distinct()

    @F.pandas_udf("string")
    def shorten(texts: pd.Series, found: pd.Series) -> pd.Series:
        keep_stores()
        out = []
        for text, ranges in zip(texts, found, strict=True):
            data = text.encode()
            whole = []
            for r in ranges:
                low, high = r["low"], r["high"]
                while low < high and data[low] & 0xC0 == 0x80:
                    low += 1
                while high > low and high < len(data) and data[high] & 0xC0 == 0x80:
                    high -= 1
                whole.append({"low": low, "high": high})
            out.append(_kept(data, whole).decode())
        return pd.Series(out, dtype="object")

    shorter = spans.join(copied, "text_key", "left_anti").select("text_key", shorten("text", "spans").alias("new_text")).unionByName(
        copied.select("text_key", F.lit("").alias("new_text")))
    own = {c: f"own_{i}" for i, c in enumerate(docs.columns)}
    joined = docs.withColumnsRenamed(own).withColumn("text_key", F.xxhash64(F.coalesce(own["text"], F.lit("")))).join(
        shorter.hint("shuffle_hash"), "text_key", "left")
    text_now = F.coalesce("new_text", own["text"])
    return joined.select(*[
        text_now.alias(c) if c == "text" else F.length(text_now).cast(docs.schema[c].dataType).alias(c) if c == "n_chars"
        else F.col(own[c]).alias(c) for c in docs.columns])
