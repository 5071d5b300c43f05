"""Operator 11, the prefix trie of conversations.

Turns are sorted in range partitions, and a numpy scan of each gives every prefix a polynomial fingerprint: the sum of
turn hashes times powers of a base, modulo two primes.  Such sums go on across partitions: what a conversation has before
a partition is one row, composed apart.  Prefixes of one length with one fingerprint are a candidate group; each member
is verified against the group's representative, its last turn by role and text and the rest by belonging to the same
group one turn before, so that all turns are compared once.  Conversations that fail are split off from that turn on under another
base, until none fails.  Sums over subtrees double their reach each round, so that a trie of depth d needs log2(d) rounds.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialize, small_side

#: Two primes below 2^31: products fit 64 bits, a pair of residues fits one long.
PRIMES = (2147483647, 2147483629)
#: Ids of conversations that end at one node are joined in chunks of about so many bytes.
CHUNK_BYTES = 1 << 18
#: A rebuilt conversation takes at most this many turns less one of its family's first.
GRAFT = 9
FAMILY = 5


def _power(base: int, exponents: np.ndarray, prime: int) -> np.ndarray:
    out, square, left = np.ones(len(exponents), np.uint64), base % prime, exponents.astype(np.uint64)
    while left.any():
        out = np.where(left & np.uint64(1), out * np.uint64(square) % np.uint64(prime), out)
        square, left = square * square % prime, left >> np.uint64(1)
    return out


def _bases(salt: int, primes: tuple[int, int]) -> tuple[int, int]:
    drawn = hashlib.sha256(f"base-{salt}".encode()).digest()
    return tuple(2 + int.from_bytes(drawn[8 * k : 8 * k + 8], "big") % (p - 3) for k, p in enumerate(primes))


def _scanner(salt: int, primes: tuple[int, int]):
    """A function over the sorted batches of a partition: place of each turn and both prefix sums, counted within it."""
    bases = _bases(salt, primes)

    def run(batches):
        last, seen, sums = None, 0, [0, 0]
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            conv = batch.column("conv_id").to_numpy()
            first = np.empty(n, bool)
            first[0] = last is None or conv[0] != last
            first[1:] = conv[1:] != conv[:-1]
            starts = np.maximum.accumulate(np.where(first, np.arange(n), -1))
            place = np.arange(n) - starts + 1  # of rows that continue the last batch: index + 2
            place = np.where(starts < 0, place - 1 + seen, place)
            columns = []
            for k, (base, prime) in enumerate(zip(bases, primes, strict=True)):
                p = np.uint64(prime)
                term = batch.column(f"h{k}").to_numpy().astype(np.uint64) % p * _power(base, place, prime) % p
                upto = np.cumsum(term)  # a batch has far fewer than 2^33 rows
                before = np.where(starts > 0, upto[np.maximum(starts - 1, 0)], np.uint64(0))
                total = (upto - before + np.where(starts < 0, np.uint64(sums[k]), np.uint64(0))) % p
                columns += [pa.array(total.astype(np.int64)), pa.array(((total + p - term) % p).astype(np.int64))]
                sums[k] = int(total[-1])
            last, seen = conv[-1], int(place[-1])
            kept = [batch.column(c) for c in ("conv_id", "role", "text")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(place.astype(np.int64)), *columns], names=["conv_id", "role", "text", "place", "s0", "q0", "s1", "q1"])

    return run


def _composer(salt: int, primes: tuple[int, int]):
    """A function over the partitions' parts of one conversation, in order: what comes before each."""
    bases = _bases(salt, primes)

    def run(parts):
        parts = parts.sort_values("part")
        n, sums, rows = 0, [0, 0], []
        for part, size, *ends in parts[["part", "n", "e0", "e1"]].itertuples(index=False):
            shift = [pow(b, n, p) for b, p in zip(bases, primes, strict=True)]
            rows.append((n, *sums, *shift))
            sums = [(s + w * int(e)) % p for s, w, e, p in zip(sums, shift, ends, primes, strict=True)]
            n += int(size)
        out = parts[["conv_id", "part"]].rename(columns={"conv_id": "c_conv", "part": "c_part"}).reset_index(drop=True)
        for k, name in enumerate(("c_n", "c_s0", "c_s1", "c_w0", "c_w1")):
            out[name] = [r[k] for r in rows]
        return out

    return run


def _pair(first: Column, second: Column) -> Column:
    return F.shiftleft(first, 31) + second


def scan_prefixes(rows: DataFrame, order: list[Column], salt: int = 0, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """conv_id, role, text, place (from 1), f and pf: the fingerprints of the prefix that ends at a turn and of that before it.

    ``rows`` has conv_id, role and text and what ``order`` needs.  A conversation may reach over any number of partitions.
    """
    spark = rows.sparkSession
    hashed = rows.select("*", *[F.xxhash64(F.lit(2 * salt + k), "role", "text").bitwiseAND((1 << 62) - 1).alias(f"h{k}") for k in (0, 1)])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = hashed.repartitionByRange(parts, "conv_id", *order).sortWithinPartitions("conv_id", *order, "role", "text")
    schema = "conv_id long, role string, text string, place long, s0 long, q0 long, s1 long, q1 long"
    local = materialize(placed.select("conv_id", "role", "text", "h0", "h1").mapInArrow(_scanner(salt, primes), schema), "scanned")
    # Part numbers order the files; each holds one range of the order.
    local = local.select("*", F.regexp_extract(F.col("_metadata.file_path"), r"part-(\d+)", 1).cast("long").alias("part"))
    # Only the first and the last conversation of a part can go on in another: at most two rows for each part.
    edges = local.groupBy("part").agg(F.min("conv_id").alias("lo"), F.max("conv_id").alias("hi"))
    cut = edges.select(F.explode(F.array_distinct(F.array("lo", "hi"))).alias("c_conv")).groupBy("c_conv").count().where("count > 1").select("c_conv")
    cut = materialize(cut, "cut")
    ends = local.join(small_side(cut), F.col("conv_id") == F.col("c_conv")).groupBy("conv_id", "part").agg(F.max("place").alias("n"), F.max_by("s0", "place").alias("e0"), F.max_by("s1", "place").alias("e1"))
    carried = ends.groupBy("conv_id").applyInPandas(_composer(salt, primes), "c_conv long, c_part long, c_n long, c_s0 long, c_s1 long, c_w0 long, c_w1 long")
    carried = materialize(carried, "carried")
    joined = local.join(small_side(carried), (F.col("conv_id") == F.col("c_conv")) & (F.col("part") == F.col("c_part")), "left")
    whole = lambda c, k: F.coalesce((F.col(f"c_s{k}") + F.col(f"c_w{k}") * F.col(f"{c}{k}")) % primes[k], F.col(f"{c}{k}"))
    return joined.select("conv_id", "role", "text", (F.col("place") + F.coalesce("c_n", F.lit(0))).alias("place"), _pair(whole("s", 0), whole("s", 1)).alias("f"), _pair(whole("q", 0), whole("q", 1)).alias("pf"))


def _cleaned(conversations: DataFrame) -> tuple[DataFrame, list[Column]]:
    """Rows with an id, null roles and texts empty, and the order of turns: null first, ties by a hash of role and text."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long"), F.col("turn").alias("turn"), empty("role"), empty("text"))
    rows = rows.withColumn("tie", F.xxhash64("role", "text"))
    return rows, [F.col("turn").asc_nulls_first(), F.col("tie")]


def rebuild(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that share first turns with their family: (turns, members).

    ``conversations`` has conv_id, turn, role and text.  With b = conv_id - conv_id % 5 and h = crc32(decimal conv_id) % 9, a
    conversation is rebuilt of the first h turns of b (all if fewer, none if b is absent) and its own turns after its first h.
    Turns has conv_id, turn (from 1), role and text; members has the conv_id of every conversation, those without a turn left
    included.  % leaves no negative rest.  Turns of one number are ordered by a hash of role and text, then by these.
    """
    rows, order = _cleaned(conversations)
    turns = scan_prefixes(rows, order).select("conv_id", "place", "role", "text")
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % GRAFT
    lengths = turns.groupBy("conv_id").agg(F.max("place").alias("n"))
    base = F.col("conv_id") - F.pmod("conv_id", F.lit(FAMILY))
    sizes = materialize(lengths.select("conv_id", "n", head.alias("h"), base.alias("base")), "lengths")
    bases = sizes.where(F.col("conv_id") == F.col("base")).select(F.col("base").alias("b"), F.col("n").alias("b_n"))
    joined = sizes.join(bases, F.col("base") == F.col("b"), "left")
    plan = materialize(joined.select(F.col("conv_id").alias("member"), "base", "h", F.least("h", F.coalesce("b_n", F.lit(0))).alias("m")), "grafts")
    own = turns.join(plan, F.col("conv_id") == F.col("member")).where(F.col("place") > F.col("h"))
    own = own.select("conv_id", (F.col("place") - F.col("h") + F.col("m")).alias("turn"), "role", "text")
    # A base has five members at most, and lends each eight turns at most.
    lent = turns.where((F.pmod("conv_id", F.lit(FAMILY)) == 0) & (F.col("place") < GRAFT)).join(plan, (F.col("conv_id") == F.col("base")) & (F.col("place") <= F.col("m")))
    lent = lent.select(F.col("member").alias("conv_id"), F.col("place").alias("turn"), "role", "text")
    return own.unionByName(lent), plan.select(F.col("member").alias("conv_id"))


def _groups(keyed: DataFrame) -> DataFrame:
    """A candidate group for each depth and fingerprint: its smallest conversation, its size, and that one's turn."""
    turn = F.struct("psalt", "pf", "role", "text")
    found = keyed.groupBy("depth", "salt", "f").agg(F.min("conv_id").alias("rep"), F.count("*").alias("n"), F.min_by(turn, "conv_id").alias("t"))
    return found.select("depth", "salt", "f", "rep", "n", "t.*")


def _failed(keyed: DataFrame, groups: DataFrame) -> DataFrame:
    """The first depth at which a conversation differs from the representative of its group: f_conv, from."""
    few = groups.where("n > 1").select(*[F.col(c).alias(f"g_{c}") for c in ("depth", "salt", "f", "rep", "psalt", "pf", "role", "text")])
    met = keyed.join(few, (F.col("depth") == F.col("g_depth")) & (F.col("salt") == F.col("g_salt")) & (F.col("f") == F.col("g_f")))
    differ = (F.col("psalt") != F.col("g_psalt")) | (F.col("pf") != F.col("g_pf")) | (F.col("role") != F.col("g_role")) | (F.col("text") != F.col("g_text"))
    return met.where((F.col("conv_id") != F.col("g_rep")) & differ).groupBy(F.col("conv_id").alias("f_conv")).agg(F.min("depth").alias("from"))


def _verified(turns: DataFrame, primes: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """(keyed, groups): the prefixes with the keys of their groups, all members of a group equal turn by turn."""
    order = [F.col("turn").asc_nulls_first(), F.col("tie")]
    plain = ["conv_id", F.col("place").alias("depth"), "f", "pf"]
    keyed = scan_prefixes(turns, order, 0, primes).select(*plain, F.lit(0).alias("salt"), F.lit(0).alias("psalt"), "role", "text")
    keyed, salt = materialize(keyed, "keyed"), 0
    while True:
        groups = materialize(_groups(keyed), "groups")
        failed = materialize(_failed(keyed, groups), "failed")
        if failed.isEmpty():
            return keyed, groups
        # Equal prefixes fail at the same turn, so they stay together under the new base.
        salt += 1
        fresh = turns.join(failed.select("f_conv"), F.col("conv_id") == F.col("f_conv"), "left_semi")
        fresh = scan_prefixes(fresh, order, salt).select(F.col("conv_id").alias("n_conv"), F.col("place").alias("n_depth"), F.col("f").alias("n_f"), F.col("pf").alias("n_pf"))
        joined = keyed.join(failed, F.col("conv_id") == F.col("f_conv"), "left").join(fresh, (F.col("conv_id") == F.col("n_conv")) & (F.col("depth") == F.col("n_depth")), "left")
        at, after = F.coalesce(F.col("depth") >= F.col("from"), F.lit(False)), F.coalesce(F.col("depth") > F.col("from"), F.lit(False))
        pick = lambda cond, new, old: F.when(cond, new).otherwise(F.col(old)).alias(old)
        keyed = materialize(joined.select("conv_id", "depth", pick(at, F.col("n_f"), "f"), pick(after, F.col("n_pf"), "pf"), pick(at, F.lit(salt), "salt"), pick(after, F.lit(salt), "psalt"), "role", "text"), "keyed")


def _subtrees(nodes: DataFrame) -> DataFrame:
    """conv_id, depth, n_leaves, saved_tokens: sums of ``leaf`` and ``saved`` over the subtree of each node.

    Round k adds to each node what its descendants at a distance of 2^k have gathered over distances below 2^k; only nodes
    of that depth and more take part.
    """
    gathered = [nodes.select("conv_id", "depth", F.col("leaf").alias("n_leaves"), F.col("saved").alias("saved_tokens"))]
    active = nodes.where("depth > 0").select("conv_id", "depth", F.col("parent_conv_id").alias("up"), F.col("leaf").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    reach = 1
    while reach <= deepest:
        if reach > 1:
            active = materialize(active, "active")
        more = active.groupBy(F.col("up").alias("conv_id"), (F.col("depth") - reach).alias("depth")).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
        more = materialize(more, "gathered")
        gathered.append(more)
        # The next round: nodes twice as deep, what they have gathered, and their ancestor at twice the distance.
        add = more.select(F.col("conv_id").alias("a_conv"), F.col("depth").alias("a_depth"), F.col("n_leaves").alias("a_leaves"), F.col("saved_tokens").alias("a_saved"))
        above = active.select(F.col("conv_id").alias("b_conv"), F.col("depth").alias("b_depth"), F.col("up").alias("b_up"))
        deep = active.where(F.col("depth") >= 2 * reach).join(above, (F.col("up") == F.col("b_conv")) & (F.col("depth") - reach == F.col("b_depth")))
        deep = deep.join(add, (F.col("conv_id") == F.col("a_conv")) & (F.col("depth") == F.col("a_depth")), "left")
        plus = lambda c, a: (F.col(c) + F.coalesce(F.col(a), F.lit(0))).alias(c)
        active = deep.select("conv_id", "depth", F.col("b_up").alias("up"), plus("n_leaves", "a_leaves"), plus("saved_tokens", "a_saved"))
        reach *= 2
    every = gathered[0]
    for more in gathered[1:]:
        every = every.unionByName(more)
    return every.groupBy("conv_id", "depth").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))


def _chunks(batches):
    """Sorted (node, depth, conv_id) rows as chunks of comma-joined ids; no node's ids are held whole."""
    names = ["node", "depth", "first", "ids"]
    for batch in batches:
        node, depth, conv = (batch.column(c).to_numpy() for c in ("node", "depth", "conv_id"))
        if not len(node):
            continue
        cuts = np.flatnonzero((node[1:] != node[:-1]) | (depth[1:] != depth[:-1])) + 1
        step = CHUNK_BYTES // 20
        bounds = [0, *cuts.tolist(), len(node)]
        spans = [(a, min(a + step, y)) for x, y in zip(bounds[:-1], bounds[1:], strict=True) for a in range(x, y, step)]
        at = [a for a, _ in spans]
        ids = [",".join(map(str, conv[a:b].tolist())).encode() for a, b in spans]
        yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(depth[at]), pa.array(conv[at]), pa.array(ids, pa.binary())], names=names)


def _digests(batches):
    """One SHA-256 for each node from its chunks in order; the state of a single hash is held."""
    now, state = None, None
    for batch in batches:
        done: list[tuple[int, int, str]] = []
        for node, depth, ids in zip(batch.column("node").to_pylist(), batch.column("depth").to_pylist(), batch.column("ids"), strict=True):
            if now != (node, depth):
                if now:
                    done.append((*now, state.hexdigest()))
                now, state = (node, depth), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.as_buffer())
        if done:
            yield _digest_batch(done)
    if now:
        yield _digest_batch([(*now, state.hexdigest())])


def _digest_batch(done):
    a, b, c = zip(*done, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c)], names=["e_node", "e_depth", "ends_sha256"])


def _ends(ends: DataFrame) -> DataFrame:
    """e_node, e_depth, ends_sha256 of ``ends`` (node, depth, conv_id).

    A SHA-256 can only be taken in order, so a node's ids pass through one task; they come as a few chunks of joined ids.
    """
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = ends.repartitionByRange(parts, "node", "depth", "conv_id").sortWithinPartitions("node", "depth", "conv_id")
    chunks = placed.mapInArrow(_chunks, "node long, depth long, first long, ids binary")
    chunks = chunks.repartition(parts, "node", "depth").sortWithinPartitions("node", "depth", "first")
    return chunks.mapInArrow(_digests, "e_node long, e_depth long, ends_sha256 string")


def prefix_trie(turns: DataFrame, members: DataFrame | None = None, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """The trie of all prefixes of conversations, a row for each node.

    ``turns`` has conv_id, turn, role and text; ``members`` the conv_id of all conversations (None: those of ``turns``), as one
    may have no turns.  A node of depth d is a distinct sequence of first d turns (role, text); the root has depth 0.
    Returns conv_id (of the smallest member), depth, parent_conv_id (null for the root), n_convs (members), n_children,
    n_leaves (nodes without children in the subtree), saved_tokens (over the subtree, members but one times the bytes of the last
    text) and ends_sha256 (of the ids, ascending and comma-joined, of the conversations that end at the node).

    Turns come by number, null first, ties by a hash of role and text, then by these; equal rows are turns of their own; null
    roles and texts are empty; rows without a conv_id are left out; an empty table has no nodes; other columns are ignored.
    """
    rows, _ = _cleaned(turns)
    keyed, groups = _verified(rows, primes)
    all_ids = (members if members is not None else keyed).select(F.col("conv_id").cast("long")).where(F.col("conv_id").isNotNull()).distinct()
    all_ids = materialize(all_ids, "members")
    root = all_ids.agg(F.min("conv_id").alias("rep"), F.count("*").alias("n")).where("n > 0")
    none = lambda kind: F.lit(0).cast(kind)
    root = root.select(none("long").alias("depth"), none("int").alias("salt"), none("long").alias("f"), "rep", "n", none("int").alias("psalt"), F.lit(None).cast("long").alias("pf"), none("long").alias("bytes"))
    known = groups.select("depth", "salt", "f", "rep", "n", "psalt", "pf", F.octet_length("text").cast("long").alias("bytes")).unionByName(root)
    known = materialize(known, "known")

    above = known.select(F.col("depth").alias("p_depth"), F.col("salt").alias("p_salt"), F.col("f").alias("p_f"), F.col("rep").alias("parent_conv_id"))
    nodes = known.join(above, (F.col("depth") - 1 == F.col("p_depth")) & (F.col("psalt") == F.col("p_salt")) & (F.col("pf") == F.col("p_f")), "left")
    nodes = materialize(nodes.select(F.col("rep").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), ((F.col("n") - 1) * F.col("bytes")).alias("saved")), "nodes")
    children = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("c_conv"), (F.col("depth") - 1).alias("c_depth")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, (F.col("conv_id") == F.col("c_conv")) & (F.col("depth") == F.col("c_depth")), "left")
    nodes = nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), "saved")
    nodes = materialize(nodes.withColumn("leaf", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")), "tree")

    # A conversation ends at the group of its last turn; one without turns at the root.
    lasts = keyed.groupBy("conv_id").agg(F.max_by(F.struct("depth", "salt", "f"), "depth").alias("k")).select("conv_id", F.struct("k.depth", "k.salt", "k.f").alias("k"))
    lasts = all_ids.join(lasts, "conv_id", "left").select("conv_id", F.coalesce("k.depth", F.lit(0)).alias("l_depth"), F.coalesce("k.salt", F.lit(0)).alias("l_salt"), F.coalesce("k.f", F.lit(0)).alias("l_f"))
    ends = lasts.join(known, (F.col("l_depth") == F.col("depth")) & (F.col("l_salt") == F.col("salt")) & (F.col("l_f") == F.col("f"))).select(F.col("rep").alias("node"), "depth", "conv_id")
    digests = _ends(ends)

    sums = _subtrees(nodes).select(F.col("conv_id").alias("s_conv"), F.col("depth").alias("s_depth"), "n_leaves", "saved_tokens")
    out = nodes.join(sums, (F.col("conv_id") == F.col("s_conv")) & (F.col("depth") == F.col("s_depth")))
    out = out.join(digests, (F.col("conv_id") == F.col("e_node")) & (F.col("depth") == F.col("e_depth")), "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
