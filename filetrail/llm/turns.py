"""Conversation structure repair: the cheapest edits that make roles alternate, found once per shared suffix of all conversations."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filetrail.llm.common import stage

BLANK = " \t\n\x0b\f\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

# States of the grammar (s?(ua)+)? over role initials: nothing yet, after s, after u, after a; roles that may follow each.
FOLLOWS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ACCEPTING = (0, 3)
# The one role that Rerole or Insert can give in each state ("s" is never given), and the state after it.
GIVEN = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
LEGAL = ("su", "ua", "au")

Move = tuple[int, str, int]  # cost-to-go, initial of the first edit, state after it
Table = tuple[Move, Move, Move, Move]


def _with_inserts(moves: list[Move]) -> Table:
    """Moves when a missing turn may also be put in; chains of inserts settle within as many rounds as there are states."""
    for _ in moves:
        moves = [min(move, (INSERT + moves[to][0], "I", to), key=lambda m: m[:2]) for move, (_, to) in zip(moves, GIVEN, strict=True)]
    return tuple(moves)


NEVER = 1 << 40
END = _with_inserts([(0 if state in ACCEPTING else NEVER, "", state) for state in range(4)])


def _before(symbol: str, after: Table) -> Table:
    """Moves of a node from those of the node of the rest: `symbol` is x (must go) or a role initial, upper case if truncated.

    In any state each kind of edit has one way to be made, so of equally cheap first edits the least initial begins the least audit.
    """
    moves = []
    for state, (_, given) in enumerate(GIVEN):
        found = [(DELETE + after[state][0], "D", state)]
        if symbol != "x":
            extra = TRUNCATED if symbol.isupper() else 0
            kept = FOLLOWS[state].get(symbol.lower())
            if kept is not None:
                found.append((KEEP + extra + after[kept][0], "K", kept))
            found.append((REROLE + extra + after[given][0], "R", given))
        moves.append(min(found, key=lambda m: m[:2]))
    return _with_inserts(moves)


class Automaton:
    """Nodes of all suffixes seen, minimised: nodes whose moves are equal but for a constant cost are one node.

    Costs of two states of a node differ by two inserts at most, so there are few nodes whatever the signatures are.
    """

    def __init__(self) -> None:
        self.tables: list[Table] = []
        self.known: dict[Table, int] = {}
        self.links: dict[tuple[str, int], tuple[int, int]] = {}
        self.end, self.end_cost = self._node(END)

    def _node(self, table: Table) -> tuple[int, int]:
        """The node of these moves and the cost that all its states have in common."""
        least = min(m[0] for m in table)
        table = tuple((cost - least, edit, to) for cost, edit, to in table)
        if table not in self.known:
            self.known[table] = len(self.tables)
            self.tables.append(table)
        return self.known[table], least

    def before(self, symbol: str, node: int) -> tuple[int, int]:
        """The node that reads `symbol` and goes on as `node`, and how much its common cost is higher."""
        link = self.links.get((symbol, node))
        if link is None:
            link = self.links[symbol, node] = self._node(_before(symbol, self.tables[node]))
        return link


def solve(signatures: Iterator[str]) -> Iterator[tuple[int, str]]:
    """Cost and audit of each signature, given in the order of their reversed texts.

    In that order signatures that end alike follow each other, so each shared suffix is entered once: the path of nodes of the signature
    before is kept as far as both end alike. A path is as long as its signature.
    """
    automaton = Automaton()
    path, costs, last = [automaton.end], [automaton.end_cost], ""
    for signature in signatures:
        turned = signature[::-1]
        common = 0
        for a, b in zip(turned, last, strict=False):
            if a != b:
                break
            common += 1
        del path[common + 1:], costs[common + 1:]
        for symbol in turned[common:]:
            node, more = automaton.before(symbol, path[-1])
            path.append(node)
            costs.append(costs[-1] + more)
        last = turned
        state, edits, at = 0, [], len(path) - 1
        while True:
            _, edit, state = automaton.tables[path[at]][state]
            if not edit:
                break
            edits.append(edit)
            at -= edit != "I"
        yield costs[-1] + automaton.tables[path[-1]][0][0], "".join(edits)


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, dropped: rows as crc32 of `conv_id:turn` modulo 20 damages them (nulls are one space).

    0 drops the row (it stays here, marked), 1 empties its text, 2 takes out its sentence marks, 3 repeats it, 4 makes it the user's.
    """
    blank = F.lit(" ")
    named = [F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")]
    kind = (F.crc32(F.concat_ws(":", *named).cast("binary")) % 20).cast("int")
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, 2).otherwise(1)
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        (F.col("kind") == 0).alias("dropped"), F.explode(F.array_repeat(F.lit(0), copies)).alias("copy")).drop("copy")


def _in_order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


FACTS = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, signature string")


def signatures(rows: DataFrame) -> DataFrame:
    """Per conversation: gaps, faults, illegal neighbours and the signature, one symbol for each row in the order of turns.

    Whether a row's role and text came earlier is known by an aggregate and a join on the text's digest; then rows without texts
    are sorted per conversation and read as a stream, so a task holds one byte a row: as much as the audit that is asked for.
    """
    trimmed = F.rtrim("text", F.lit(BLANK))
    narrow = stage(rows.select(
        "conv_id", "turn", "role", _digest(F.col("text")).alias("digest"), "dropped", (trimmed == "").alias("blank"),
        (~trimmed.substr(F.length(trimmed), F.lit(1)).isin(".", "!", "?")).alias("truncated")), "turn-facts")
    known = F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn").alias("turn"))
    first = narrow.filter("not dropped and not blank").groupBy("conv_id", "role", "digest").agg(F.min(known).alias("first")).select(
        F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    marked = narrow.join(first, same, "left").select(
        "conv_id", "turn", "role", "digest", "dropped", "blank", "truncated",
        F.coalesce(~F.col("first.turn").eqNullSafe(F.col("turn")), F.lit(False)).alias("later"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in FACTS.split(", ")]
        done: list[tuple] = []
        started, current = False, None

        def finish() -> None:
            gaps = most - least + 1 - turns if turns else 0
            done.append((current, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, symbols.decode()))

        for batch in batches:
            for conv, turn, role, digest, dropped, blank, truncated, later in zip(
                    *(c.to_pylist() for c in batch.columns), strict=True):
                if not started or conv != current:
                    if started:
                        finish()
                    started, current = True, conv
                    least = most = before = initial = None
                    turns = illegal = 0
                    counts, symbols = dict.fromkeys(("blank", "duplicate", "truncated"), 0), bytearray()
                if dropped:
                    continue
                if turn is not None and turn != most:
                    least, most, turns = turn if least is None else least, turn, turns + 1
                role_initial = role[:1]
                illegal += initial is not None and initial + role_initial not in LEGAL
                initial = role_initial
                same = (turn, role, digest)
                fault = "blank" if blank else "duplicate" if later or same == before else "truncated" if truncated else None
                before = same
                if fault:
                    counts[fault] += 1
                symbol = role_initial if role_initial in ("s", "u", "a") else "o"
                symbols += (symbol if not fault else symbol.upper() if fault == "truncated" else "x").encode()
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)] if done else [
                pa.array([], pa.int64())] * 6 + [pa.array([], pa.string())], names=names).cast(SCHEMA)
            done.clear()
        if started:
            finish()
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=names).cast(SCHEMA)

    return marked.repartition("conv_id").sortWithinPartitions("conv_id", *_in_order()).mapInArrow(run, FACTS)


SCHEMA = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in FACTS.split(", ")])


def edits(facts: DataFrame) -> DataFrame:
    """(signature, cost, audit) of each different signature, over the automaton of all of them.

    Signatures are dealt out by ranges of their reversed texts, so those that share a suffix meet in one task and in a row.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[str]:
            for batch in batches:
                for signature in batch.column("signature").to_pylist():
                    held.append(signature)
                    yield signature

        held: list[str] = []
        found: list[tuple[int, str]] = []
        size = 0
        for cost, audit in solve(each()):
            found.append((cost, audit))
            size += len(audit)
            if size > 1 << 22 or len(found) == 1 << 14:
                yield made(held, found)
                held.clear()
                found.clear()
                size = 0
        yield made(held, found)

    def made(held: list[str], found: list[tuple[int, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array(held, pa.string()), pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())],
            names=["signature", "cost", "audit"])

    turned = facts.select("signature").distinct().withColumn("turned", F.reverse("signature"))
    return turned.repartitionByRange("turned").sortWithinPartitions("turned").mapInArrow(
        run, "signature string, cost long, audit string")


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): each conversation's rows after the edits of its audit, as `role:text` joined by line ends.

    A digest over a conversation is sequential, so its rows pass through one task: as a sorted stream of which one row is held.
    """
    head = audits.select(
        "conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"),
        F.lit(b"").alias("digest"), F.col("audit").alias("text"))
    body = rows.filter("not dropped").select(
        "conv_id", F.lit(1).alias("kind"), "turn", "role", _digest(F.col("text")).alias("digest"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, script, edit, state, first, digest = None, None, 0, 0, True, hashlib.sha256()

        def put(role: str, text: str) -> None:
            nonlocal first
            digest.update(("" if first else "\n").encode() + f"{role}:{text}".encode())
            first = False

        def inserts() -> None:
            nonlocal edit, state
            while edit < len(script) and script[edit] == "I":
                role, state = GIVEN[state]
                put(role, "")
                edit += 1

        def result() -> tuple[int | None, str]:
            inserts()
            return conv, digest.hexdigest()

        for batch in batches:
            done = []
            ids, kinds, roles, texts = (batch.column(c) for c in ("conv_id", "kind", "role", "text"))
            for i, (kind, role) in enumerate(zip(kinds.to_pylist(), roles.to_pylist(), strict=True)):
                text = texts[i].as_py()
                if not kind:
                    if script is not None:
                        done.append(result())
                    conv, script, edit, state, first, digest = ids[i].as_py(), text, 0, 0, True, hashlib.sha256()
                    continue
                inserts()
                act = script[edit]
                edit += 1
                if act == "R":
                    role, state = GIVEN[state]
                elif act == "K":
                    state = FOLLOWS[state][role[:1]]
                if act != "D":
                    put(role, text)
            yield out(done)
        if script is not None:
            yield out([result()])

    def out(done: list[tuple[int | None, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([c for c, _ in done], pa.int64()), pa.array([h for _, h in done], pa.string())], names=["conv_id", "repaired_sha256"])

    stream = head.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *_in_order())
    return stream.mapInArrow(run, "conv_id long, repaired_sha256 string")


def repair(rows: DataFrame) -> DataFrame:
    """The structure of conversations and their cheapest repair, from rows of conv_id, turn, role, text and `dropped` (as `damage` gives them).

    Rows are taken by turn, nulls first; rows of one turn by role and text digest, so that equal ones are neighbours. A row's first fault counts: blank,
    duplicate (role and text seen earlier), truncated (its last character is no sentence mark). Returns per conv_id gaps, blank, duplicate,
    truncated, illegal, cost, audit (initials of Keep, Rerole, Delete, Insert), repaired_sha256. A null conv_id is a conversation like others. Dropped
    rows count for nothing, but their conversations are returned: zeros, empty audit, digest of the empty string. Roles other than those of the
    grammar can only be reroled or deleted. An empty table gives no row; other columns are ignored.

    Signatures (a symbol of role and fault per row) are folded over all conversations; those that end alike share nodes of one automaton,
    minimised from the end, and each node has its cost-to-go and best first edit once per state of the grammar.
    """
    facts = stage(signatures(rows), "turn-signatures")
    audited = stage(facts.join(edits(facts), "signature").drop("signature"), "turn-audits")
    hashes = repaired(rows, audited)
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    other = hashes.select(F.col("conv_id").alias("c"), "repaired_sha256")
    return audited.join(other, audited["conv_id"].eqNullSafe(other["c"])).select("conv_id", *names, "repaired_sha256")


# The same by a table of whole audit texts per position and state, filled from the end of each conversation.
ORACLE_SQL = r"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS body,
    concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' ')) AS name FROM conversations
), hashed AS (
  SELECT *, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(1, length(name) + 1), lambda i: ascii(substring(name, i, 1))::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, k: xor(v >> 1, 3988292384 * (v & 1))))) % 20 AS kind
  FROM named
), damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(body, '[.!?]', '', 'g') ELSE body END AS body,
    unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM hashed WHERE kind <> 0
), placed AS (
  SELECT *, row_number() OVER w AS pos, lag(substring(role, 1, 1)) OVER w AS before,
    regexp_extract(body, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS ending
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(body))
), faults AS (
  SELECT *, substring(role, 1, 1) AS initial, CASE WHEN ending = '' THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, body ORDER BY pos) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(ending, '[.!?]') THEN 'truncated' ELSE '' END AS fault
  FROM placed
), facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
    count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE before IS NOT NULL AND concat(before, initial) NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM faults GROUP BY conv_id
), filled(conv_id, pos, b) AS (
  SELECT conv_id, n + 1, [{'c': 0, 'a': ''}, {'c': 10, 'a': 'II'}, {'c': 5, 'a': 'I'}, {'c': 0, 'a': ''}] FROM facts
  UNION ALL
  SELECT conv_id, pos, b FROM (
    SELECT conv_id, pos, list_transform([1, 2, 3, 4], lambda g: list_min([one[g], {'c': 5 + one[[3, 3, 4, 3][g]].c, 'a': concat('I', one[[3, 3, 4, 3][g]].a)}])) AS b FROM (
      SELECT conv_id, pos, list_transform([1, 2, 3, 4], lambda g: list_min([base[g], {'c': 5 + base[[3, 3, 4, 3][g]].c, 'a': concat('I', base[[3, 3, 4, 3][g]].a)}])) AS one FROM (
        SELECT f.conv_id, f.pos, list_transform([1, 2, 3, 4], lambda g: list_min([
          {'c': 2 + b[g].c, 'a': concat('D', b[g].a)},
          CASE WHEN f.fault IN ('blank', 'duplicate') THEN {'c': 1000000000, 'a': ''}
            ELSE {'c': 1 + CASE f.fault WHEN 'truncated' THEN 5 ELSE 0 END + b[[3, 3, 4, 3][g]].c, 'a': concat('R', b[[3, 3, 4, 3][g]].a)} END,
          CASE WHEN f.fault IN ('blank', 'duplicate') OR NOT contains(['su', 'u', 'a', 'u'][g], f.initial) OR f.initial = '' THEN {'c': 1000000000, 'a': ''}
            ELSE {'c': CASE f.fault WHEN 'truncated' THEN 5 ELSE 0 END + b[CASE f.initial WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END].c,
              'a': concat('K', b[CASE f.initial WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END].a)} END])) AS base
        FROM filled s JOIN faults f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.pos = s.pos - 1)))
), audits AS (
  SELECT conv_id, b[1].c AS cost, b[1].a AS audit FROM filled WHERE pos = 1
), acts AS (
  SELECT conv_id, i, substring(audit, i, 1) AS act, i - length(regexp_replace(substring(audit, 1, i), '[^I]', '', 'g')) AS pos,
    length(regexp_replace(substring(audit, i + 1), 'D', '', 'g')) AS left_over
  FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS i FROM audits)
), texts AS (
  SELECT a.conv_id, a.i, concat(CASE WHEN act = 'K' THEN f.role WHEN left_over % 2 = 0 THEN 'assistant' ELSE 'user' END, ':',
    CASE WHEN act = 'I' THEN '' ELSE f.body END) AS line
  FROM acts a LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM a.conv_id AND f.pos = a.pos WHERE act <> 'D'
), joined AS (
  SELECT conv_id, string_agg(line, chr(10) ORDER BY i) AS body FROM texts GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(j.body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN audits a ON a.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN joined j ON j.conv_id IS NOT DISTINCT FROM o.conv_id
"""
