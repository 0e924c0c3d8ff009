r"""Prefix trie of rebuilt conversations, by fingerprints that compose.

Conversation c is rebuilt from the first h turns of its base b = c - c % 5 and its own turns after its first h,
h = crc32(c) % 9.  Every distinct sequence of first turns (role, text) of rebuilt conversations is a node.

No rebuilt text is ever made.  A stored turn is known by a 128-bit key, and the texts of all turns with one key are
compared with each other (`_one_text_each`), so a key is a reference to one (role, text).  The fingerprint of turns
t1 .. td is the sum of t_i * B^i, modulo four primes: sequences compose by shifting one by a power of B and adding,
which is a monoid (with inverses), so the fingerprint of the first d turns of a rebuilt conversation is

    Q_b(h') + B^(h' - h) * (Q_c(h + d - h') - Q_c(h)),     h' = min(h, turns of b),

from sums of the stored turns alone.  Turns with equal fingerprint and depth form a group; a group is accepted only if all
its members refer to the same last turn.  Then what is left of the fingerprint, that of one turn less, is equal as well, so
by induction over the depth equal groups are equal sequences.  If a key has two texts or a group two last turns, all
is done again with other keys and another B: results do not rest on chance.

Turns are ordered and summed up by a range partitioning of (conversation, turn): a conversation may span any number of tasks,
and one row for each task carries what the next one needs.  Sums over subtrees take one round for each power of 2 up
to the greatest depth: a round adds to each node what the nodes 2^k below have gathered, and the ancestor of a node is
looked up in its smallest member at depth d - 2^k, so no key of these joins is hot.  Ids of the conversations that end at a
node are ordered by range too and hashed as a stream; long groups arrive as packed strings.

Defined results: a null turn number comes first; turns of one number are ordered by the key of their content and
equal ones count as often as they are there; null role or text is empty; rows without a conversation id belong to none;
without any conversation there is no node; other columns are ignored.  A conversation whose rebuilt form has no turns ends at
the root.  `c % 5` has the sign of c, as in SQL.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from framesift.llm.common import partitions
from framesift.session import materialise

#: Conversations of one base, and the modulus of the turns that are taken from it.
BLOCK, HEADS = 5, 9
#: The four largest primes below 2^31, so that products fit 64 bits and two fit one number.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
ATTEMPTS = 8
#: Ids that one packed row holds.
PACKED = 4096

_Q = [f"q{i}" for i in range(len(PRIMES))]
_KEY = ["key1", "key2"]
_NODE = ["depth", "f1", "f2"]


def bases(seed: int) -> list[int]:
    """B for each prime."""
    raw = hashlib.sha256(f"base {seed}".encode()).digest()
    return [int.from_bytes(raw[8 * i:8 * i + 8], "big") % (p - 3) + 2 for i, p in enumerate(PRIMES)]


def turn_keys(role: Column, text: Column, seed: int) -> list[Column]:
    return [F.xxhash64(F.lit(2 * seed + i), role, text).alias(k) for i, k in enumerate(_KEY)]


class Collision(Exception):
    """Two things had one name; another seed is needed."""


def _one_text_each(rows: DataFrame) -> None:
    """Every key has one (role, text): the only step that moves texts, each distinct one of a task once."""
    texts = rows.groupBy(*_KEY, "role", "text").agg(F.lit(1))
    if texts.groupBy(*_KEY).count().where("count > 1").limit(1).count():
        raise Collision


def _generators(key1: np.ndarray, key2: np.ndarray) -> list[np.ndarray]:
    """A number below each prime from a turn's key."""
    halves = [x.astype(np.uint64) for x in (key1, key2)]
    parts = [halves[0] & np.uint64(0xFFFFFFFF), halves[0] >> np.uint64(32), halves[1] & np.uint64(0xFFFFFFFF), halves[1] >> np.uint64(32)]
    return [x % np.uint64(p) for x, p in zip(parts, PRIMES)]


def powers(base: int, exponents: np.ndarray, prime: int) -> np.ndarray:
    """base ** exponents modulo prime."""
    found, square, left = np.ones(len(exponents), np.uint64), np.uint64(base), exponents.astype(np.uint64)
    while left.any():
        odd = (left & np.uint64(1)).astype(bool)
        found[odd] = found[odd] * square % np.uint64(prime)
        square = square * square % np.uint64(prime)
        left = left >> np.uint64(1)
    return found


def _summed(ordered: DataFrame, own: list[int]) -> DataFrame:
    """Numbers and running sums of turns within their conversation and task (`seg`); the last row of a task is marked."""
    names = ["conv", "seg", "at", *_Q, *_KEY, "bytes", "last"]

    def sums(batch: pa.RecordBatch, seg: int, before: tuple | None) -> tuple[pa.RecordBatch, tuple]:
        conv = batch.column(0).to_numpy()
        keys = [batch.column(i).to_numpy() for i in (1, 2)]
        n = len(conv)
        first = np.flatnonzero(np.append(True, conv[1:] != conv[:-1]))
        run = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
        goes_on = before is not None and before[0] == conv[0]
        at = np.arange(n) - first[run] + 1
        at[run == 0] += before[1] if goes_on else 0
        columns = []
        for i, (prime, t) in enumerate(zip(PRIMES, _generators(*keys))):
            # Terms are below 2^31, so 2^32 rows of a batch can be added up in 64 bits.
            total = np.concatenate(([np.uint64(0)], np.cumsum(t * powers(own[i], at, prime) % np.uint64(prime), dtype=np.uint64)))
            q = (total[1:] - total[first][run]) % np.uint64(prime)
            if goes_on:
                q[run == 0] = (q[run == 0] + np.uint64(before[2][i])) % np.uint64(prime)
            columns.append(q.astype(np.int64))
        out = pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.full(n, seg)), pa.array(at), *map(pa.array, columns), *(pa.array(k) for k in keys),
             batch.column(3), pa.array(np.zeros(n, bool))], names)
        return out, (conv[-1], int(at[-1]), [int(q[-1]) for q in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg, before, held = TaskContext.get().partitionId(), None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                yield held
            held, before = sums(batch, seg, before)
        if held is not None:
            mark = np.zeros(held.num_rows, bool)
            mark[-1] = True
            yield held.set_column(len(names) - 1, "last", pa.array(mark))
    kinds = ", ".join(f"{c} {'boolean' if c == 'last' else 'long'}" for c in names)
    return ordered.select("conv", *_KEY, "bytes").mapInArrow(run, kinds)


def _carried(stored: DataFrame, own: list[int]) -> DataFrame:
    """The stored turns with sums over their whole conversation.

    A task's first conversation may have begun in tasks before; what it had by then is one row for each task, worked out
    from one row for each task, so what goes to the driver and back is bounded by the number of tasks.
    """
    rows, carry = [], None
    for r in stored.where("last").select("seg", "conv", "at", *_Q).orderBy("seg").collect():
        q = [r[c] for c in _Q]
        if carry is not None:
            rows.append((r.seg, *carry))
        if carry is not None and carry[0] == r.conv:
            n = carry[1]
            carry = (r.conv, n + r.at, *((c + pow(b, n, p) * x) % p for c, x, b, p in zip(carry[2:], q, own, PRIMES)))
        else:
            carry = (r.conv, r.at, *q)
    if not rows:
        return stored.drop("seg", "last")
    # The power of B that lifts a task's own sums is known as well.
    rows = [(*r, *(pow(b, r[2], p) for b, p in zip(own, PRIMES))) for r in rows]
    kinds = "seg long, conv long, before long, " + ", ".join(f"{x}{i} long" for x in ("s", "l") for i in range(len(PRIMES)))
    table = F.broadcast(stored.sparkSession.createDataFrame(rows, kinds))
    lifted = [F.when(F.col("before").isNull(), F.col(q)).otherwise((F.col(f"s{i}") + F.col(f"l{i}") * F.col(q)) % p).alias(q)
              for i, (q, p) in enumerate(zip(_Q, PRIMES))]
    return stored.join(table, ["seg", "conv"], "left").select(
        "conv", (F.col("at") + F.coalesce("before", F.lit(0))).alias("at"), *lifted, *_KEY, "bytes")


def _plans(turns: DataFrame, own: list[int]) -> DataFrame:
    """One row per conversation: its first turns (at most 8), how it is rebuilt, and what is added to its own sums."""
    first = F.when(F.col("at") < HEADS, F.struct("at", *_Q, *_KEY, "bytes"))
    convs = materialise(turns.groupBy("conv").agg(F.max("at").alias("n"), F.array_sort(F.collect_list(first)).alias("first")), "trie_conversations")
    taken = F.crc32(F.col("conv").cast("string")) % HEADS
    named = convs.select("conv", "n", "first", taken.alias("h"), (F.col("conv") - F.col("conv") % BLOCK).alias("base"))
    base = convs.select(F.col("conv").alias("base"), F.col("first").alias("theirs"))
    heads = F.coalesce(F.slice("theirs", 1, F.col("h").cast("int")), F.array().cast(convs.schema["first"].dataType))
    joined = named.join(base, "base", "left").select("conv", "n", "h", "first", F.when(F.col("h") > 0, heads).otherwise(
        F.array().cast(convs.schema["first"].dataType)).alias("heads"))
    joined = joined.withColumn("taken", F.size("heads").cast("long"))
    length = F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    shift = (F.col("h") - F.col("taken")).cast("int")
    plans = joined.select("*", length.alias("length"), *[
        F.element_at(F.array(*[F.lit(pow(b, -k, p)) for k in range(HEADS)]), shift + 1).alias(f"m{i}")
        for i, (b, p) in enumerate(zip(own, PRIMES))])
    mine = F.when(F.col("h") > 0, F.get(F.col("first"), (F.least("h", "n") - 1).cast("int")))
    theirs = F.get(F.col("heads"), (F.col("taken") - 1).cast("int"))
    added = [F.pmod(F.coalesce(theirs[q], F.lit(0)) - F.col(f"m{i}") * F.coalesce(mine[q], F.lit(0)) % p, F.lit(p)).alias(f"a{i}")
             for i, (q, p) in enumerate(zip(_Q, PRIMES))]
    return plans.select("conv", "h", "taken", "length", "heads", *[f"m{i}" for i in range(len(PRIMES))], *added)


def _fingerprint(q: list[Column]) -> list[Column]:
    return [(q[0] * (1 << 31) + q[1]).alias("f1"), (q[2] * (1 << 31) + q[3]).alias("f2")]


def _members(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv, depth, f1, f2, key, bytes, ends): every first part of every rebuilt conversation but the empty one."""
    head = plans.where("taken > 0").select("conv", "length", F.explode("heads").alias("x")).select("conv", "length", "x.*")
    heads = head.select("conv", F.col("at").alias("depth"), *_fingerprint([F.col(q) for q in _Q]), *_KEY, "bytes",
                        (F.col("at") == F.col("length")).alias("ends"))
    slim = plans.select("conv", "h", "taken", "length", *[f"{x}{i}" for x in "am" for i in range(len(PRIMES))])
    depth = F.col("at") - F.col("h") + F.col("taken")
    own = turns.where(F.col("at") > F.crc32(F.col("conv").cast("string")) % HEADS).join(slim, "conv").select(
        "conv", depth.alias("depth"), *_fingerprint([(F.col(f"a{i}") + F.col(f"m{i}") * F.col(q)) % p for i, (q, p) in enumerate(zip(_Q, PRIMES))]),
        *_KEY, "bytes", (depth == F.col("length")).alias("ends"))
    return heads.unionByName(own)


def _groups(members: DataFrame) -> DataFrame:
    """Nodes below the root, each checked: all its members refer to one last turn."""
    same = [F.min(k) == F.max(k) for k in _KEY]
    nodes = materialise(members.groupBy(*_NODE).agg(
        F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.min("bytes").alias("bytes"),
        (same[0] & same[1]).alias("same")), "trie_nodes")
    if nodes.where("not same").limit(1).count():
        raise Collision
    return nodes.drop("same")


def _ends(members: DataFrame, plans: DataFrame) -> DataFrame:
    """(node, ends_sha256) of every node that conversations end at."""
    ends = members.where("ends").select(*_NODE, "conv").unionByName(
        plans.where("length = 0").select(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("f1"),
                                         F.lit(0).cast("long").alias("f2"), "conv"))
    n = partitions(members.sparkSession)
    ordered = ends.repartitionByRange(n, *_NODE, "conv").sortWithinPartitions(*_NODE, "conv")
    packed = materialise(ordered.mapInArrow(_pack, "depth long, f1 long, f2 long, conv long, ids string, sha string"), "trie_ends")
    parts = packed.where("sha IS NULL").repartition(n, *_NODE).sortWithinPartitions(*_NODE, "conv")
    streamed = parts.mapInArrow(_stream, "depth long, f1 long, f2 long, sha string")
    return packed.where("sha IS NOT NULL").select(*_NODE, "sha").unionByName(streamed).withColumnRenamed("sha", "ends_sha256")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of each node joined by commas: hashed at once where a task holds the whole node in one batch."""
    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["depth", "f1", "f2", "conv", "ids", "sha"])

    def runs() -> Iterator[tuple[tuple, list[int], bool]]:
        """(node, ids, whether it is all of the node): nodes at either end of a task may go on in others."""
        node, ids, open_ = None, [], True
        for batch in batches:
            key = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            conv = batch.column(3).to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, [len(conv)]))
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                this = tuple(key[a].tolist())
                if node is not None and this != node:
                    yield node, ids, not open_
                    node, ids, open_ = this, [], False
                elif node is None:
                    node = this
                ids += conv[a:b].tolist()
                while len(ids) > PACKED:
                    yield node, ids[:PACKED], False
                    ids, open_ = ids[PACKED:], True
        if ids:
            yield node, ids, False
    rows: list[tuple] = []
    for node, ids, whole in runs():
        text = ",".join(map(str, ids))
        rows.append((*node, ids[0], None if whole else text, hashlib.sha256(text.encode()).hexdigest() if whole else None))
        if len(rows) >= 1024:
            yield out(rows)
            rows = []
    if rows:
        yield out(rows)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed ids of a node follow each other in order; one digest runs along."""
    done: list[tuple] = []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), [pa.int64()] * 3 + [pa.string()])],
                                          ["depth", "f1", "f2", "sha"])
    node, digest = None, None
    for batch in batches:
        for depth, f1, f2, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4))):
            if (depth, f1, f2) != node:
                if node is not None:
                    done.append((*node, digest.hexdigest()))
                node, digest = (depth, f1, f2), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if len(done) >= 1024:
            yield out()
            done.clear()
    if node is not None:
        done.append((*node, digest.hexdigest()))
    if done:
        yield out()


def _with_subtrees(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """Nodes (with the root) and their parent, children, leaves below and tokens saved below."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    places = members.select(F.col("conv").alias("m_conv"), F.col("depth").alias("m_depth"), F.col("f1").alias("up1"), F.col("f2").alias("up2"))

    def above(of: DataFrame, step: int) -> DataFrame:
        """Nodes with the fingerprint of their ancestor `step` levels up, found in their smallest member."""
        deep = of.where(F.col("depth") > step)
        found = deep.join(places.where(F.col("m_depth") <= deepest - step),
                          (F.col("conv") == F.col("m_conv")) & (F.col("depth") - step == F.col("m_depth"))).drop("m_conv", "m_depth")
        root = F.lit(0).cast("long")
        return found.unionByName(of.where(F.col("depth") == step).withColumn("up1", root).withColumn("up2", root))

    def gathered(of: DataFrame, step: int, **sums: Column) -> DataFrame:
        return (above(of, step).groupBy((F.col("depth") - step).alias("depth"), F.col("up1").alias("f1"), F.col("up2").alias("f2"))
                .agg(*[c.alias(k) for k, c in sums.items()]))
    children = gathered(nodes, 1, n_children=F.count(F.lit(1)))
    saved = F.when(F.col("depth") > 0, (F.col("n_convs") - 1) * F.col("bytes")).otherwise(0)
    state = materialise(nodes.join(children, _NODE, "left").select(
        *nodes.columns, F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.col("n_children").isNull().cast("long").alias("n_leaves"), saved.cast("long").alias("saved_tokens")), "trie_state")
    step = 1
    while step <= deepest:
        more = gathered(state, step, more_leaves=F.sum("n_leaves"), more_saved=F.sum("saved_tokens"))
        state = materialise(state.join(more, _NODE, "left").select(
            *nodes.columns, "n_children", (F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"),
            (F.col("saved_tokens") + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens")), "trie_state")
        step *= 2
    parents = state.select(F.col("depth").alias("p_depth"), F.col("f1").alias("p1"), F.col("f2").alias("p2"), F.col("conv").alias("parent_conv_id"))
    named = above(state, 1).join(parents, (F.col("up1") == F.col("p1")) & (F.col("up2") == F.col("p2")) & (F.col("depth") - 1 == F.col("p_depth")))
    return named.select(*state.columns, "parent_conv_id").unionByName(
        state.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))


def _build(rows: DataFrame, seed: int) -> DataFrame:
    own = bases(seed)
    spark = rows.sparkSession
    keyed = rows.select("conv", "turn", "role", "text", *turn_keys(F.col("role"), F.col("text"), seed))
    # A number for each row makes the order total, so that equal rows may lie in different tasks; it is stored, hence fixed.
    slim = materialise(keyed.select("conv", "turn", *_KEY, F.octet_length("text").cast("long").alias("bytes"),
                                    F.monotonically_increasing_id().alias("row")), "trie_turns")
    _one_text_each(keyed)
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), *map(F.col, _KEY), F.col("row")]
    ordered = slim.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    turns = _carried(materialise(_summed(ordered, own), "trie_sums"), own)
    plans = materialise(_plans(turns, own), "trie_plans")
    members = materialise(_members(turns, plans), "trie_members")
    zero = F.lit(0).cast("long")
    root = plans.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        zero.alias("depth"), zero.alias("f1"), zero.alias("f2"), "conv", "n_convs", zero.alias("bytes"))
    nodes = _groups(members).unionByName(root)
    ends = _ends(members, plans)
    found = _with_subtrees(nodes, members).join(ends, _NODE, "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return found.select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))


def trie(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per node; see the contract above."""
    rows = conversations.where(F.col(f"`{conv}`").isNotNull()).select(
        F.col(f"`{conv}`").cast("long").alias("conv"), F.col(f"`{turn}`").alias("turn"),
        F.coalesce(f"`{role}`", F.lit("")).alias("role"), F.coalesce(f"`{text}`", F.lit("")).alias("text"))
    for seed in range(ATTEMPTS):
        try:
            return _build(rows, seed)
        except Collision:
            continue
    raise RuntimeError(f"{ATTEMPTS} sets of keys in a row had collisions")
