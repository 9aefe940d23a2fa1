"""Conversation structure repair with a persistent audit DP.

A conversation's rows, in the order of their turns, are edited at the least cost
so that the role initials become `(s?(ua)+)?`; the edits' initials are the audit,
and of equally cheap audits the ASCII-least is taken.

Edits: Keep 0, Rerole to user/assistant 2, Delete 3 (required for blank and
duplicate rows), Insert an empty user/assistant row anywhere 2; a truncated row
that is not deleted adds 1.

1. Rows are range-partitioned by conversation and turn and sorted, so a hot
   conversation is a run of segments over several partitions. What a duplicate
   repeats is known from an aggregate over hashes before.
2. Each partition streams its rows. A segment has bounded rows and text; its DP
   state is where the pattern stands. Audits share their beginnings as
   linked nodes, each with binary-lifting ancestors and a rolling hash of its
   string; equally cheap audits are compared by searching their longest common
   prefix over the ancestors, and equal hashes are verified by walking the nodes.
   A conversation inside one partition and segment is finished there.
3. Others give a table of the cheapest audit from each state to each state. The
   tables of a conversation are composed in order (one small row for a segment),
   and the chosen pieces go back to the segments.
4. Segments are repaired, and a conversation's digest is streamed over them.

Equally cheap audits of the same rows are never prefixes of each other (the longer
one would insert more), so the least string is made of least pieces.

Defined results: a null role or text is one space; a null turn comes first; equal
turns go by role and text; rows with a null conv_id are one conversation; a
role whose initial is none of s, u, a cannot be kept; a conversation without rows
costs nothing; an empty table gives no rows; other columns are ignored.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockboard.llm.common import scratch

SEGMENT_ROWS, SEGMENT_BYTES = 4096, 4 << 20
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
BASE, MODULUS = 1_000_003, (1 << 61) - 1
BEGIN, SYSTEM, USER, ASSISTANT = range(4)               # where the pattern stands
INF = 1 << 60
NOT_BLANK = re.compile(r"[^\x20\x09-\x0D]")


def after(state: int, initial: str) -> int | None:
    """The state after a role initial, None where the pattern does not allow it."""
    if initial == "u":
        return None if state == USER else USER
    if initial == "a":
        return ASSISTANT if state == USER else None
    return SYSTEM if initial == "s" and state == BEGIN else None


class Audits:
    """Strings that share their beginnings: node 0 is the empty one."""

    def __init__(self):
        self.parent, self.char, self.length, self.hash, self.up = [0], [""], [0], [0], [[0]]

    def grown(self, node: int, char: str) -> int:
        new = len(self.parent)
        self.parent.append(node)
        self.char.append(char)
        self.length.append(self.length[node] + 1)
        self.hash.append((self.hash[node] * BASE + ord(char)) % MODULUS)
        lift, at = [node], node
        while len(self.up[at]) >= len(lift) and at:
            at = self.up[at][len(lift) - 1]
            lift.append(at)
        self.up.append(lift)
        return new

    def lifted(self, node: int, steps: int) -> int:
        k = 0
        while steps:
            if steps & 1:
                node = self.up[node][k] if k < len(self.up[node]) else 0
            steps >>= 1
            k += 1
        return node

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.char[node])
            node = self.parent[node]
        return "".join(reversed(out))

    def same(self, a: int, b: int) -> bool:
        """Two nodes of one length and hash: are their strings equal?"""
        while a != b:
            if self.char[a] != self.char[b]:
                return False
            a, b = self.parent[a], self.parent[b]
        return True

    def less(self, a: int, b: int) -> bool:
        """Whether the string of `a` comes before that of `b`."""
        shorter = self.length[a] < self.length[b]
        n = min(self.length[a], self.length[b])
        x, y = self.lifted(a, self.length[a] - n), self.lifted(b, self.length[b] - n)
        if self.hash[x] == self.hash[y]:
            return shorter if self.same(x, y) else self.text(a) < self.text(b)
        for k in reversed(range(min(len(self.up[x]), len(self.up[y])))):
            if k < len(self.up[x]) and k < len(self.up[y]) and self.hash[self.up[x][k]] != self.hash[self.up[y][k]]:
                x, y = self.up[x][k], self.up[y][k]
        if not self.same(self.parent[x], self.parent[y]):
            return self.text(a) < self.text(b)                   # a collision of hashes
        return self.char[x] < self.char[y]

    def best(self, options: list[tuple[int, int, str]]) -> tuple[int, int]:
        """The cheapest of (cost, node, char to add), the least string among equals; (INF, 0) if there is none."""
        least = min((c for c, _, _ in options), default=INF)
        if least >= INF:
            return INF, 0
        found = None
        for cost, node, char in options:
            if cost == least:
                node = self.grown(node, char) if char else node
                found = node if found is None or self.less(node, found) else found
        return least, found


def inserted(audits: Audits, states: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """After insertions: one or two are enough, since a whole pair never pays."""
    begin, system, user, assistant = states
    user = audits.best([(*user, "")] + [(c + INSERT, n, "I") for c, n in (begin, system, assistant) if c < INF])
    assistant = audits.best([(*assistant, "")] + ([(user[0] + INSERT, user[1], "I")] if user[0] < INF else []))
    return [begin, system, user, assistant]


def stepped(audits: Audits, states: list[tuple[int, int]], initial: str, fault: str) -> list[tuple[int, int]]:
    """One row: insertions before it, then Delete, Keep or Rerole."""
    options: list[list[tuple[int, int, str]]] = [[], [], [], []]
    extra = TRUNCATED if fault == "t" else 0
    for state, (cost, node) in enumerate(inserted(audits, states)):
        if cost >= INF:
            continue
        options[state].append((cost + DELETE, node, "D"))
        if fault in "bd" and fault:
            continue
        to = after(state, initial)
        if to is not None:
            options[to].append((cost + extra, node, "K"))
        role = "a" if state == USER else "u"
        if role != initial:
            options[after(state, role)].append((cost + REROLE + extra, node, "R"))
    return [audits.best(o) for o in options]


def table_of(rows: list[tuple], starts: tuple[int, ...]) -> dict[int, list[tuple[int, str]]]:
    """For each start state the cheapest (cost, audit) to each state. rows: (initial, fault, ...)."""
    out = {}
    for start in starts:
        audits = Audits()
        states = [(0 if s == start else INF, 0) for s in range(4)]
        for initial, fault, *_ in rows:
            states = stepped(audits, states, initial, fault)
        out[start] = [(c, audits.text(n) if c < INF else "") for c, n in states]
    return out


def finished(ends: list[tuple[int, str]]) -> tuple[int, str, int, str]:
    """(cost, audit, last state before the insertions at the end, these insertions) of the cheapest way to end."""
    ways = []
    for state, (cost, audit) in enumerate(ends):
        if cost < INF:
            for tail, ok in (("", state in (BEGIN, ASSISTANT)), ("I", state == USER), ("II", state != USER)):
                if ok:
                    ways.append((cost + INSERT * len(tail), audit + tail, state, tail))
    return min(ways)


def repaired(rows: list[tuple[str, str]], audit: str, state: int) -> list[str]:
    """`role:text` of the rows (role, text) after the edits."""
    out, at = [], 0
    for edit in audit:
        role, text = ("", "") if edit == "I" else rows[at]
        at += edit != "I"
        if edit == "D":
            continue
        if edit != "K":
            role = "assistant" if state == USER else "user"
        state = after(state, role[:1])
        out.append(f"{role}:{text}")
    return out


def fault_of(text: str, seen: bool) -> str:
    marks = NOT_BLANK.findall(text[-64:]) or NOT_BLANK.findall(text)
    if not marks:
        return "b"
    return "d" if seen else "" if marks[-1] in ".!?" else "t"


class Segment:
    """Rows of one conversation that follow each other."""

    def __init__(self, number: int):
        self.number, self.rows, self.bytes = number, [], 0

    def add(self, turn, role: str, text: str, seen: bool) -> None:
        self.rows.append((role[:1], fault_of(text, seen), turn, role, text))
        self.bytes += len(role) + len(text)

    def full(self, rows: int, size: int) -> bool:
        return len(self.rows) >= rows or self.bytes >= size

    def stats(self) -> dict:
        turns = [r[2] for r in self.rows if r[2] is not None]
        initials = [r[0] for r in self.rows]
        return {"blank": sum(r[1] == "b" for r in self.rows), "duplicate": sum(r[1] == "d" for r in self.rows),
                "truncated": sum(r[1] == "t" for r in self.rows),
                "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
                "first": initials[0], "last": initials[-1], "low": min(turns, default=None), "high": max(turns, default=None),
                "turns": len(set(turns))}


STATS = ("blank", "duplicate", "truncated", "illegal", "first", "last", "low", "high", "turns")


def schema_of(conv: str, turn: str) -> str:
    return (f"kind string, conv_id {conv}, part int, segment int, blank long, duplicate long, truncated long, illegal long, "
            f"first string, last string, low {turn}, high {turn}, turns long, cost long, audit string, sha string, "
            "costs array<long>, audits array<string>, roles array<string>, texts array<string>")


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
NAMES = ("kind", "conv_id", "part", "segment", *STATS, "cost", "audit", "sha", "costs", "audits", "roles", "texts")


def arrow_schema(conv: pa.DataType, turn: pa.DataType) -> pa.Schema:
    texts = pa.list_(pa.string())
    kinds = {"kind": pa.string(), "conv_id": conv, "part": pa.int32(), "segment": pa.int32(), "first": pa.string(),
             "last": pa.string(), "low": turn, "high": turn, "audit": pa.string(), "sha": pa.string(),
             "costs": pa.list_(pa.int64()), "audits": texts, "roles": texts, "texts": texts}
    return pa.schema([(n, kinds.get(n, pa.int64())) for n in NAMES])


def streamer(segment_rows: int, segment_bytes: int):
    """Sorted rows to finished conversations (f) and, for those that may go on in another partition or have several
    segments, tables (m) and rows (t) of their segments."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, schema, out = TaskContext.get().partitionId(), None, []
        opened, conv, segment, before, first = False, None, None, None, True

        def closed(whole: bool) -> None:
            base = {"conv_id": conv, "part": part, "segment": segment.number, **segment.stats()}
            if whole:
                cost, audit, _, _ = finished(table_of(segment.rows, (BEGIN,))[BEGIN])
                text = "\n".join(repaired([r[3:] for r in segment.rows], audit, BEGIN))
                out.append({"kind": "f", **base, "cost": cost, "audit": audit, "sha": hashlib.sha256(text.encode()).hexdigest()})
                return
            table = table_of(segment.rows, (BEGIN, SYSTEM, USER, ASSISTANT))
            cells = [c for start in range(4) for c in table[start]]
            out.append({"kind": "m", **base, "costs": [c for c, _ in cells], "audits": [a for _, a in cells]})
            out.append({"kind": "t", "conv_id": conv, "part": part, "segment": segment.number,
                        "roles": [r[3] for r in segment.rows], "texts": [r[4] for r in segment.rows]})

        for batch in batches:
            if schema is None:
                schema = arrow_schema(batch.schema.field("conv_id").type, batch.schema.field("turn").type)
            for c, turn, role, text, seen in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "turn", "role", "text", "seen")),
                                                 strict=True):
                if not opened or c != conv:
                    if opened:
                        closed(whole=not first and segment.number == 0)
                        first = False
                    opened, conv, segment, before = True, c, Segment(0), None
                elif segment.full(segment_rows, segment_bytes):
                    closed(whole=False)
                    segment = Segment(segment.number + 1)
                segment.add(turn, role, text, seen or (turn, role, text) == before)
                before = (turn, role, text)
                if len(out) >= 512 or (out and segment.bytes >= segment_bytes):
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out.clear()
        if opened:
            closed(whole=False)                              # it may go on in the next partition
            yield pa.RecordBatch.from_pylist(out, schema)
    return run


def composed(rows: list[dict]) -> tuple[dict, list[tuple[int, str]]]:
    """Stats, cost and audit of a conversation from its segments' tables in order; and (start state, piece) of each."""
    stats = {k: sum(r[k] for r in rows) for k in ("blank", "duplicate", "truncated", "illegal", "turns")}
    for a, b in zip(rows, rows[1:]):
        stats["illegal"] += a["last"] + b["first"] not in ("su", "ua", "au")
        stats["turns"] -= a["high"] is not None and a["high"] == b["low"]
    low, high = [r["low"] for r in rows if r["low"] is not None], [r["high"] for r in rows if r["high"] is not None]
    stats["gaps"] = max(high) - min(low) + 1 - stats["turns"] if low else 0
    ends, back = [(0 if s == BEGIN else INF, "") for s in range(4)], []
    for r in rows:
        new, came = [], []
        for to in range(4):
            ways = [(ends[s][0] + r["costs"][4 * s + to], ends[s][1] + r["audits"][4 * s + to], s)
                    for s in range(4) if ends[s][0] < INF and r["costs"][4 * s + to] < INF]
            best = min(ways, default=(INF, "", 0))
            new.append(best[:2])
            came.append(best[2])
        ends = new
        back.append(came)
    cost, audit, state, tail = finished(ends)
    pieces = []
    for r, came in zip(reversed(rows), reversed(back)):
        start = came[state]
        pieces.append((start, r["audits"][4 * start + state]))
        state = start
    pieces.reverse()
    pieces[-1] = (pieces[-1][0], pieces[-1][1] + tail)
    return stats | {"cost": cost, "audit": audit}, pieces


def composer(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["segment"]))
    result, pieces = composed(rows)
    keys = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    out = [{"conv_id": r["conv_id"], "part": r["part"], "segment": r["segment"], "state": s, "piece": p,
            **({k: result[k] for k in keys} if not i else {})} for i, (r, (s, p)) in enumerate(zip(rows, pieces, strict=True))]
    schema = pa.schema([("conv_id", table.schema.field("conv_id").type), ("part", pa.int32()), ("segment", pa.int32()),
                        ("state", pa.int32()), ("piece", pa.string()), *((k, pa.int64()) for k in keys[:-1]), ("audit", pa.string())])
    return pa.Table.from_pylist(out, schema)


def segment_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = ["\n".join(repaired(list(zip(roles, texts, strict=True)), piece, state)) or None
                 for roles, texts, piece, state in zip(*(batch.column(c).to_pylist() for c in ("roles", "texts", "piece", "state")),
                                                       strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("part"), batch.column("segment"),
                                          pa.array(texts, pa.string())], ["conv_id", "part", "segment", "text"])


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the segments of each conversation in order, one segment held at a time."""
    opened, conv, digest, empty, kind = False, None, None, True, None
    for batch in batches:
        ids, shas, kind = [], [], batch.schema.field("conv_id").type
        for c, text in zip(batch.column("conv_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if not opened or c != conv:
                if opened:
                    ids.append(conv)
                    shas.append(digest.hexdigest())
                opened, conv, digest, empty = True, c, hashlib.sha256(), True
            if text is not None:
                digest.update((text if empty else "\n" + text).encode())
                empty = False
        yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(shas, pa.string())], ["conv_id", "sha"])
    if opened:
        yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([digest.hexdigest()], pa.string())], ["conv_id", "sha"])


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text) with faults that follow from crc32(`conv_id:turn`) % 20."""
    c = conversations
    space = lambda name: F.coalesce(c[name].cast("string"), F.lit(" "))
    rows = c.select(c["conv_id"], c["turn"], space("role").alias("role"), space("text").alias("text"),
                    (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20).alias("kind")).where("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def repair(rows: DataFrame, segment_rows: int = SEGMENT_ROWS, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    spark = rows.sparkSession
    c = rows.select(rows["conv_id"], rows["turn"], F.coalesce(rows["role"], F.lit(" ")).alias("role"),
                    F.coalesce(rows["text"], F.lit(" ")).alias("text"))
    conv, turn = (c.schema[x].dataType.simpleString() for x in ("conv_id", "turn"))
    hashed = c.withColumn("h1", F.xxhash64("role", "text")).withColumn("h2", F.xxhash64(F.lit(1), "role", "text"))
    firsts = hashed.groupBy("conv_id", "h1", "h2").agg(F.min(F.struct("turn")).alias("t"), F.count("*").alias("m"),
                                                       F.min("conv_id").alias("c"), F.min("h1").alias("g1"), F.min("h2").alias("g2")) \
        .where("m > 1").select("c", "g1", "g2", F.col("t.turn").alias("since"), F.lit(True).alias("repeated"))
    marked = hashed.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("h1") == F.col("g1"))
                         & (F.col("h2") == F.col("g2")), "left")
    seen = F.coalesce(F.col("repeated"), F.lit(False)) & ~F.col("turn").eqNullSafe(F.col("since"))
    ordered = marked.select("conv_id", "turn", "role", "text", seen.alias("seen"), F.left("text", F.lit(32)).alias("head")) \
        .repartitionByRange("conv_id", "turn", "role", "head").sortWithinPartitions("conv_id", "turn", "role", "text") \
        .select("conv_id", "turn", "role", "text", "seen")

    def stored(df: DataFrame, name: str) -> DataFrame:
        path = scratch(spark, f"conversations-{name}")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    made = stored(ordered.mapInArrow(streamer(segment_rows, segment_bytes), schema_of(conv, turn)), "segments")
    gaps = F.when(F.col("low").isNull(), 0).otherwise(F.col("high") - F.col("low") + 1 - F.col("turns")).cast("long")
    numbers = ["blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    done = made.where("kind = 'f'").select("conv_id", gaps.alias("gaps"), *numbers, F.col("sha").alias("repaired_sha256"))
    tables = made.where("kind = 'm'").select("conv_id", "part", "segment", *STATS, "costs", "audits")
    pieces = stored(tables.groupBy("conv_id").applyInArrow(
        composer, f"conv_id {conv}, part int, segment int, state int, piece string, {RESULT}"), "pieces")
    of = pieces.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.col("segment").alias("s"), "state", "piece")
    texts = made.where("kind = 't'").select("conv_id", "part", "segment", "roles", "texts")
    texts = texts.join(of, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")) & (F.col("segment") == F.col("s"))) \
        .mapInArrow(segment_texts, f"conv_id {conv}, part int, segment int, text string")
    shas = texts.repartition("conv_id").sortWithinPartitions("conv_id", "part", "segment") \
        .mapInArrow(digests, f"conv_id {conv}, sha string").select(F.col("conv_id").alias("c"), F.col("sha").alias("repaired_sha256"))
    split = pieces.where("audit is not null").join(shas, F.col("conv_id").eqNullSafe(F.col("c"))) \
        .select("conv_id", "gaps", *numbers, "repaired_sha256")
    return done.unionByName(split)


def repaired_conversations(rows: DataFrame, ids: DataFrame, **options) -> DataFrame:
    """`repair` with a row for every conv_id of `ids`, also for those that have no rows."""
    found = repair(rows, **options).withColumnRenamed("conv_id", "c")
    every = ids.select(ids["conv_id"]).distinct()
    zero = lambda name: F.coalesce(F.col(name), F.lit(0).cast("long")).alias(name)
    return every.join(found, every["conv_id"].eqNullSafe(found["c"]), "left").select(
        "conv_id", *(zero(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repaired_conversations(damaged(conversations), conversations)
