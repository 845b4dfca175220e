"""The prefix trie of conversations, by an external mergesort that carries common prefixes.

A turn is 24 bytes (a hash and the length of its text), a conversation the bytes of its turns. Tasks sort bounded runs and keep,
for each row, the turns it shares with the row before (its LCP); runs are a written table, dealt out in ranges of (turns, id).
A task merges its pieces of runs with a tree of losers whose matches compare LCPs first and turns only beyond them, so shared
turns are not compared again. The merged stream drives a stack of open nodes: a node is finished when the stream leaves it.

Nodes on the path of a range's first or last row may lie in several ranges. They come out as partial sums, and what two
neighbouring ranges both counted (nodes that the last row of one shares with the first row of the next) is taken off.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from synthloom.llm.common import measured, parts, table, text_of, written

#: Bytes of a turn: 16 of its hash, 8 of its text's length.
TURN = 24
#: Bytes of a sorted run, and of a range, in the mean.
RUN_BYTES, RANGE_BYTES = 16 << 20, 32 << 20
#: Conversations whose ids are hashed at a time.
IDS = 1 << 15

Row = tuple[bytes, int]


def turn_key(role: Column, text: Column) -> Column:
    """24 bytes for a turn: half the SHA-256 of (role, text), then the bytes of the text. Nulls are empty."""
    role, text = text_of(role), text_of(text)
    held = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.concat(F.substring(F.unhex(F.sha2(held.cast("binary"), 256)), 1, 16), F.unhex(F.lpad(F.hex(F.octet_length(text).cast("long")), 16, "0")))


def sequences(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, seq): the turns of each conversation, by turn (null first; ties by key), as one binary value.

    Rows without an id are of no conversation and are left out; repeated rows are turns of their own. A conversation is one
    value, of 24 bytes a turn whatever its texts' lengths.
    """
    keyed = turns.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("conv_id"), F.struct(F.col(turn_col).alias("t"), turn_key(F.col(role_col), F.col(text_col)).alias("k")).alias("s"))
    hexed = F.transform(F.sort_array(F.collect_list("s")), lambda s: F.hex(s["k"]))
    return keyed.groupBy("conv_id").agg(F.unhex(F.array_join(hexed, "")).alias("seq"))


def rebuilt(seqs: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """seqs with each conversation c rebuilt: the first h turns of conversation c - c % every, then its own after its first h;
    h is the CRC-32 of the decimal c, modulo `most`. Ids are whole numbers."""
    c, h = F.col("conv_id"), F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    heads = seqs.filter(c % every == 0).select(c.alias("_base"), F.substring("seq", 1, TURN * (most - 1)).alias("_head"))
    joined = seqs.withColumns({"_base": c - c % every, "_h": (h * TURN).cast("int")}).join(heads, "_base", "left")
    head = F.coalesce(F.col("_head").substr(F.lit(1), F.col("_h")), F.lit(b""))
    return joined.select("conv_id", F.concat(head, F.col("seq").substr(F.col("_h") + 1, F.octet_length("seq"))).alias("seq"))


def shared(a: bytes, b: bytes, start: int = 0) -> int:
    """The turns with which both begin, of which `start` are known."""
    k, most = start * TURN, min(len(a), len(b))
    while k < most and a[k : k + TURN] == b[k : k + TURN]:
        k += TURN
    return k // TURN


def run_of(rows: list[Row]) -> list[tuple[bytes, int, int]]:
    """A sorted run: (seq, id, LCP with the row before)."""
    rows.sort()
    return [(seq, i, shared(rows[k - 1][0], seq) if k else 0) for k, (seq, i) in enumerate(rows)]


class Losers:
    """A tree of losers over sorted runs. A run's head carries the turns that it shares with the row given out last; of two
    heads the one that shares more is less, and only equal ones are compared, from there on."""

    def __init__(self, runs: list[list[tuple[bytes, int, int]]]):
        self.runs, self.at = runs, [0] * len(runs)
        self.lcp = [0] * len(runs)
        self.leaves = 1 << max(0, len(runs) - 1).bit_length()
        self.tree = [-1] * self.leaves
        self.winner = self._built(1)

    def _built(self, node: int) -> int:
        if node >= self.leaves:
            run = node - self.leaves
            return run if run < len(self.runs) and self.runs[run] else -1
        winner, self.tree[node] = self._match(self._built(2 * node), self._built(2 * node + 1))
        return winner

    def _match(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's LCP becomes that with the winner."""
        if a < 0 or b < 0:
            return max(a, b), -1
        if self.lcp[a] != self.lcp[b]:
            return (a, b) if self.lcp[a] > self.lcp[b] else (b, a)
        (x, i, _), (y, j, _) = self.runs[a][self.at[a]], self.runs[b][self.at[b]]
        same = shared(x, y, self.lcp[a])
        winner, loser = (a, b) if (x[same * TURN :], i) <= (y[same * TURN :], j) else (b, a)
        self.lcp[loser] = same
        return winner, loser

    def __iter__(self) -> Iterator[tuple[bytes, int, int]]:
        """(seq, id, LCP with the row before) of all rows in order."""
        while self.winner >= 0:
            run = self.winner
            seq, i, _ = self.runs[run][self.at[run]]
            yield seq, i, self.lcp[run]
            self.at[run] += 1
            over = self.at[run] == len(self.runs[run])
            if not over:
                self.lcp[run] = self.runs[run][self.at[run]][2]
            winner, node = -1 if over else run, (run + self.leaves) // 2
            while node:
                winner, self.tree[node] = self._match(winner, self.tree[node])
                node //= 2
            self.winner = winner


@dataclass
class Open:
    """A node that the stream has not left: sums over what it has seen of it."""

    size: int
    least: int
    convs: int = 0
    children: int = 0
    leaves: int = 0
    saved: int = 0
    ends: list[int] = field(default_factory=list)


COLUMNS = "kind int, node binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, ends array<long>, pid int, head binary, tail binary"
NODE, EDGE, ENDS, BOUND = range(4)


def ids_hash(ids: Iterable[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def path_keys(seq: bytes, depth: int, known: list[bytes] | None = None) -> list[bytes]:
    """Keys of the nodes at depths 0 to `depth` on the path of seq, each a hash of the one above and a turn."""
    keys = known if known else [b""]
    while len(keys) <= depth:
        k = len(keys)
        keys.append(hashlib.sha256(keys[-1] + seq[(k - 1) * TURN : k * TURN]).digest()[:16])
    return keys


def nodes_of(rows: Iterable[tuple[bytes, int, int]], pid: int) -> Iterator[dict]:
    """The nodes that a range's rows, in order and with their LCPs, pass through, and the range's first and last row.

    saved_tokens is the sum of n_convs x bytes, less the bytes of each node once. A row's node is a leaf unless the next row
    goes on from it; the next range's first row is not seen here, and what it changes is taken off later.
    """
    stack: list[Open] = []
    head = tail = b""
    edge = 0  # nodes of the stack, from the root, that lie on the first row's path
    keys: list[bytes] = []

    def closed(last: bool) -> Iterator[dict]:
        depth = len(stack) - 1
        node, above = stack.pop(), stack[-1] if stack else None
        node.saved += (node.convs - 1) * node.size
        if not node.children:
            node.leaves = 1
        mark = last or depth < edge
        if above:
            above.convs += node.convs
            above.children += 1
            above.leaves += node.leaves
            above.saved += node.saved
            above.least = min(above.least, node.least)
        up = above is not None and (last or depth - 1 < edge)
        if mark or up:
            path_keys(tail, depth if mark else depth - 1, keys)
        # a parent's least member is known when it is closed, and its children wait for that, unless it is known to be an edge
        out = {"conv_id": node.least, "depth": depth, "n_convs": node.convs, "n_children": node.children, "n_leaves": node.leaves, "saved_tokens": node.saved}
        if mark:
            for k in range(0, len(node.ends), IDS):
                yield {"kind": ENDS, "node": keys[depth], "ends": node.ends[k : k + IDS]}
            yield out | {"kind": EDGE, "node": keys[depth], "parent": keys[depth - 1] if depth else None}
        else:
            yield out | {"kind": NODE, "parent": keys[depth - 1] if up else None, "ends_sha256": ids_hash(node.ends), "_up": None if up else id(above)}

    # children of a node that is open yet wait until its least member is sure
    waiting: dict[int, list[dict]] = {}

    def settled(found: Iterator[dict]) -> Iterator[dict]:
        for row in found:
            up = row.pop("_up", None)
            below = waiting.pop(row.pop("_id", 0), [])
            for child in below:
                yield child | ({"parent": row["node"]} if row["kind"] == EDGE else {"parent_conv_id": row["conv_id"]})
            if up is None:
                yield row
            else:
                waiting.setdefault(up, []).append(row)

    def popped(last: bool) -> Iterator[dict]:
        me = id(stack[-1])
        for row in closed(last):
            yield row | ({"_id": me} if row["kind"] in (NODE, EDGE) else {})

    for k, (seq, i, lcp) in enumerate(rows):
        if not k:
            head, keys = seq, [b""]
            stack.append(Open(0, i))
        else:
            while len(stack) > lcp + 1:
                yield from settled(popped(False))
            edge = min(edge, lcp + 1)
            del keys[lcp + 1 :]
        for at in range(len(stack) - 1, len(seq) // TURN):
            stack.append(Open(int.from_bytes(seq[at * TURN + 16 : (at + 1) * TURN], "big"), i))
        if not k:
            edge = len(stack)
        stack[-1].convs += 1
        stack[-1].least = min(stack[-1].least, i)
        stack[-1].ends.append(i)
        tail = seq
    if stack:
        while stack:
            yield from settled(popped(True))
        yield {"kind": BOUND, "pid": pid, "head": head, "tail": tail}


def _rows(found: Iterable[dict], size: int = 4096) -> Iterator[pa.RecordBatch]:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    fields = [c.split() for c in COLUMNS.split(", ")]
    held: list[dict] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in held], kinds[t]) for n, t in fields], [n for n, _ in fields])

    for row in found:
        held.append(row)
        if len(held) == size:
            yield batch()
            held = []
    yield batch()


def _sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of about RUN_BYTES, each in order; `run` is their number in the task."""
    rows, size, k = [], 0, 0

    def out() -> Iterator[pa.RecordBatch]:
        run = run_of(rows)
        for a in range(0, len(run), 4096):
            seq, ids, lcp = zip(*run[a : a + 4096], strict=True)
            n = len(seq)
            yield pa.RecordBatch.from_arrays([pa.array([k] * n, pa.int32()), pa.array(range(a, a + n), pa.int32()), pa.array(seq, pa.binary()), pa.array(ids, pa.int64()), pa.array(lcp, pa.int32())], ["run", "at", "seq", "conv_id", "lcp"])

    for batch in batches:
        for seq, i in zip(batch.column("seq").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            rows.append((seq, i))
            size += len(seq) + 100
            if size >= RUN_BYTES:
                yield from out()
                rows, size, k = [], 0, k + 1
    if rows:
        yield from out()


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of one range, whose rows come run by run."""
    runs: list[list[tuple[bytes, int, int]]] = []
    last, pid = None, 0
    for batch in batches:
        for task, run, seq, i, lcp, p in zip(*(batch.column(c).to_pylist() for c in ("task", "run", "seq", "conv_id", "lcp", "pid")), strict=True):
            if (task, run) != last:
                last, pid = (task, run), p
                runs.append([])
            runs[-1].append((seq, i, lcp))
    yield from _rows(nodes_of(Losers(runs), pid))


def _taken_off(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What neighbouring ranges both counted: for each node that the rows `before` and `head` share, what to add to its sums."""
    for batch in batches:
        out: list[dict] = []
        for before, head in zip(batch.column("before").to_pylist(), batch.column("head").to_pylist(), strict=True):
            depth = shared(before, head)
            keys = path_keys(head, depth)
            ended = len(before) == depth * TURN  # before's own node was taken for a leaf if it had no child
            size = 0
            for d in range(depth, -1, -1):
                size += int.from_bytes(head[d * TURN - 8 : d * TURN], "big") if d else 0
                out.append({"kind": EDGE, "node": keys[d], "n_convs": 0, "saved_tokens": size, "n_children": -1 if d < depth else 0, "n_leaves": -1 if ended else 0})
        yield from _rows(out)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each node's ids; their blocks come in order, so no node's ids meet in memory."""
    now, digest, empty = None, None, True
    for batch in batches:
        for node, ids in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if node != now:
                if now is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([digest.hexdigest()])], ["node", "hash"])
                now, digest, empty = node, hashlib.sha256(), True
            digest.update((("" if empty else ",") + ",".join(map(str, ids))).encode())
            empty = False
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([digest.hexdigest()])], ["node", "hash"])


def prefix_trie(seqs: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations (conv_id long, seq of 24 bytes a turn; see sequences()).

    Returns conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. No
    rows give no node. Equal conversations may be any share of all: they are dealt to ranges by id too, and only their ids
    meet in one task, in order and block by block, as SHA-256 asks.
    """
    spark = seqs.sparkSession
    runs = written(seqs.mapInArrow(_sorted_runs, "run int, at int, seq binary, conv_id long, lcp int").withColumn("task", F.spark_partition_id()), "runs")
    size = runs.agg(F.sum(F.octet_length("seq") + 100)).first()[0] or 0
    ranges = max(parts(spark), -(-size // RANGE_BYTES))
    dealt = runs.repartitionByRange(ranges, "seq", "conv_id").withColumn("pid", F.spark_partition_id()).sortWithinPartitions("task", "run", "at")
    found = written(dealt.mapInArrow(_merged, COLUMNS), "found")
    bounds = found.filter(F.col("kind") == BOUND).select("pid", "head", "tail")
    between = bounds.withColumn("before", F.lag("tail").over(Window.orderBy("pid"))).filter("before is not null")  # a row a range
    edges = found.filter(F.col("kind") == EDGE).unionByName(between.select("before", "head").mapInArrow(_taken_off, COLUMNS))
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    edges = edges.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent").alias("parent"), *sums)
    ends = found.filter(F.col("kind") == ENDS).select("node", "ends", F.col("ends")[0].alias("first"))
    hashes = ends.repartition("node").sortWithinPartitions("node", "first").select("node", "ends").mapInArrow(_hashed, "node binary, hash string")
    edges = written(edges.join(hashes, "node", "left").withColumn("ends_sha256", F.coalesce("hash", F.lit(ids_hash([])))).drop("hash"), "edges")
    above = measured(edges.select(F.col("node").alias("parent"), F.col("conv_id").alias("_up")), row_bytes=64)
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    inner = found.filter(F.col("kind") == NODE)
    both = inner.select("parent", *columns).unionByName(edges.withColumn("parent_conv_id", F.lit(None).cast("long")).select("parent", *columns))
    return both.join(above, "parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_up")).select(*columns)


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations. Null roles and texts are empty; a null turn comes first; rows that repeat
    are turns of their own; rows without conv_id are left out; no rows give no node."""
    return prefix_trie(rebuilt(sequences(table(spark, sf_dir, "conversations"))))


OP13_SQL = """
WITH t AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
turns AS (
  SELECT conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS turn, turn AS place FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(turn ORDER BY place NULLS FIRST, turn) AS s FROM turns GROUP BY conv_id),
coded AS (SELECT own.*, hex(encode(CAST(conv_id AS VARCHAR))) AS x FROM own),
hashed AS (
  SELECT conv_id, s, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]))) % 9 AS h
  FROM coded, t),
built AS (SELECT a.conv_id, list_concat(coalesce(b.s[1:a.h], []), a.s[a.h + 1:]) AS s FROM hashed a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 5),
paths AS (SELECT conv_id, len(s) AS len, unnest(range(len(s) + 1)) AS depth, s FROM built),
keyed AS (SELECT conv_id, depth, len, CASE WHEN depth = 0 THEN '' ELSE sha256(CAST(s[1:depth] AS VARCHAR)) END AS k, CASE WHEN depth > 0 THEN strlen(s[depth]['text']) ELSE 0 END AS size FROM paths),
nodes AS (
  SELECT depth, k, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len = depth), '')) AS ends_sha256
  FROM keyed GROUP BY depth, k),
named AS (SELECT p.conv_id AS member, p.depth, n.conv_id FROM keyed p JOIN nodes n ON n.depth = p.depth AND n.k = p.k),
tied AS (SELECT n.*, up.conv_id AS parent_conv_id FROM nodes n LEFT JOIN named up ON up.member = n.conv_id AND up.depth = n.depth - 1),
children AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n FROM tied WHERE depth > 0 GROUP BY ALL),
counted AS (SELECT t.*, coalesce(c.n, 0) AS n_children FROM tied t LEFT JOIN children c ON c.conv_id = t.conv_id AND c.depth = t.depth),
below AS (
  SELECT a.conv_id, a.depth, sum(CASE WHEN c.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((c.n_convs - 1) * c.size) AS saved
  FROM counted c JOIN named a ON a.member = c.conv_id AND a.depth <= c.depth GROUP BY ALL)
SELECT c.conv_id, c.depth, c.parent_conv_id, c.n_convs, c.n_children, CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, c.ends_sha256
FROM counted c JOIN below b ON b.conv_id = c.conv_id AND b.depth = c.depth
"""
