"""A prefix trie of conversations, as a z-fast trie kept in tables.

A conversation is a string of turns. The compacted trie has a node for the end of each
distinct string and for each place where strings part; a node's extent is the longest
prefix that all strings below it share. A node is filed under the hash of one prefix of
its extent, its handle: the prefix whose length is the two-fattest number (the one
divisible by the largest power of two) between its parent's extent and its own. So the
node at which a string leaves the trie is found by a fat binary search, in as many
lookups as the length has bits.

Strings are inserted in batches. Each round of the search is a join of one probe a
string with the table of handles. Strings that leave the trie in the same edge are not
gathered: every depth below the exit is a row under the hash of its prefix, and the
smallest and largest next turn of a prefix tell whether strings part there.

Prefixes are named by two 64-bit hashes that are combined by exclusive or, so those of a
long conversation are computed in chunks by separate tasks. They are written once, in
buckets of string and depth: probes of every round and batch go to the buckets, and the
prefixes themselves are not shuffled again to meet them.
"""

import hashlib
import uuid
from functools import reduce

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldspark.llm.common import iterate_batches
from fieldspark.storage import cut_lineage, new_path

BATCHES = 3
# Turns of a conversation, and conversations of an equal text, that one task handles together.
CHUNK = 1 << 12
BUCKET_ROWS = 1 << 21
IDS = 1 << 14
WORD = r"[^\x20\x09-\x0D]+"
NODE = ["depth", "ha", "hb"]
NOTHING = hashlib.sha256(b"").hexdigest()


# -- strings -------------------------------------------------------------------


def number_turns(conversations):
    """``conv_id, depth (from 1), sym1, sym2, words`` of every turn that has a conv_id.

    Turns are ordered by turn (null first), then role and text. The sort is by range
    over all conversations, so a conversation of any length is numbered by many tasks:
    a turn's depth is its row number less that of the conversation's first row.
    """
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("tie"),
    ).where("conv_id IS NOT NULL")
    ordered = turns.orderBy("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "tie")
    rows = cut_lineage(
        ordered.select(
            "conv_id",
            F.xxhash64(F.lit(1), "role", "text").alias("sym1"),
            F.xxhash64(F.lit(2), "text", "role").alias("sym2"),
            F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"),
            F.spark_partition_id().alias("part"),
            F.monotonically_increasing_id().alias("slot"),
        )
    )
    # One row a sort partition passes through the running sum.
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("slot").alias("low"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("low")).alias("shift"))
    rows = rows.join(F.broadcast(starts), "part").withColumn("row", F.col("slot") + F.col("shift"))
    first = rows.groupBy("conv_id").agg(F.min("row").alias("first"))
    return rows.join(first, "conv_id").select(
        "conv_id", (F.col("row") - F.col("first") + 1).alias("depth"), "sym1", "sym2", "words"
    )


def rebuild(turns, group=20, kinds=4):
    """Conversations with their first turns taken from the first of their group of ids.

    Conversation c starts with the first h turns of conversation c - c % ``group``, h
    the crc32 of its id modulo ``kinds``, and goes on with its own after the first h.
    Every conversation has a row of depth 0 as well.
    """
    ids = turns.groupBy("conv_id").agg(F.max("depth").alias("own"))
    ids = ids.select(
        "conv_id",
        (F.col("conv_id") - F.col("conv_id") % group).alias("base"),
        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % kinds).alias("head"),
    )
    lead = turns.where((F.col("conv_id") % group == 0) & (F.col("depth") < kinds))
    lengths = lead.groupBy(F.col("conv_id").alias("base")).agg(F.max("depth").alias("there"))
    ids = cut_lineage(
        ids.join(lengths, "base", "left").withColumn(
            "there", F.least("head", F.coalesce("there", F.lit(0)))
        )
    )
    taken = ids.select("conv_id", "base", "there").join(
        lead.withColumnRenamed("conv_id", "base"), "base"
    ).where("depth <= there")
    kept = turns.join(ids.where("head > 0").select("conv_id", "head", "there"), "conv_id", "left")
    kept = kept.where("head IS NULL OR depth > head").withColumn(
        "depth", F.when(F.col("head").isNull(), F.col("depth")).otherwise(F.col("depth") - F.col("head") + F.col("there"))
    )
    columns = ["conv_id", "depth", "sym1", "sym2", "words"]
    zero = F.lit(0).cast("long")
    roots = ids.select("conv_id", *[zero.alias(c) for c in columns[1:]])
    return roots.union(taken.select(columns)).union(kept.select(columns))


def _at_depth(rows):
    """The turns' hashes with their place in them; nothing for the row of depth 0."""
    place = lambda c: F.when(F.col("depth") > 0, F.xxhash64("depth", c)).otherwise(F.lit(0)).alias(c)
    return rows.select("conv_id", "depth", place("sym1"), place("sym2"), "words")


def whole_strings(rows):
    """``conv_id, depth, ha, hb, total``: length, hashes and words of each conversation."""
    return _at_depth(rows).groupBy("conv_id").agg(
        F.max("depth").alias("depth"),
        F.bit_xor("sym1").alias("ha"),
        F.bit_xor("sym2").alias("hb"),
        F.sum("words").alias("total"),
    )


def prefixes(rows, strings):
    """A row for each prefix of each of ``strings``: its hashes ``ha, hb``, those of the
    prefix one turn shorter ``pa, pb``, the words of its last turn and ``before`` it."""
    rows = _at_depth(rows).join(strings.select("conv_id", "length", "batch"), "conv_id")
    rows = rows.withColumn("chunk", F.expr(f"depth div {CHUNK}"))
    inside = W.partitionBy("conv_id", "chunk").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns(
        {
            "ha": F.bit_xor("sym1").over(inside),
            "hb": F.bit_xor("sym2").over(inside),
            "before": F.sum("words").over(inside) - F.col("words"),
        }
    )
    parts = rows.where(F.col("length") >= CHUNK).groupBy("conv_id", "chunk")
    parts = parts.agg(F.bit_xor("sym1").alias("xa"), F.bit_xor("sym2").alias("xb"), F.sum("words").alias("xw"))
    earlier = W.partitionBy("conv_id").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(
        "conv_id", "chunk", *[f(c).over(earlier).alias(c) for f, c in ((F.bit_xor, "xa"), (F.bit_xor, "xb"), (F.sum, "xw"))]
    )
    short = rows.where(F.col("length") < CHUNK)
    zero = F.lit(0).cast("long")
    long = rows.where(F.col("length") >= CHUNK).join(parts, ["conv_id", "chunk"])
    rows = short.withColumns({c: zero for c in ("xa", "xb", "xw")}).unionByName(long)
    mixed = lambda c, x: F.col(c).bitwiseXOR(F.coalesce(x, zero))
    rows = rows.withColumns(
        {"ha": mixed("ha", "xa"), "hb": mixed("hb", "xb"), "before": F.col("before") + F.coalesce("xw", zero)}
    )
    return rows.select(
        "conv_id", "batch", "length", *NODE, "words", "before",
        F.col("ha").bitwiseXOR(F.col("sym1")).alias("pa"),
        F.col("hb").bitwiseXOR(F.col("sym2")).alias("pb"),
    )


# -- the trie ------------------------------------------------------------------


def two_fattest(low, high):
    """SQL of the number in (low, high] that the largest power of two divides."""
    bits = f"(length(bin({low} ^ {high})) - 1)"
    return f"shiftleft(shiftright({high}, {bits}), {bits})"


def _at(prefix_rows, frame, depth, **columns):
    """``frame`` with columns of its string's prefix of the given depth."""
    found = prefix_rows.select(
        "conv_id", F.col("depth").alias(depth), *[F.col(c).alias(n) for n, c in columns.items()]
    )
    return frame.join(found, ["conv_id", depth])


def _with_handles(nodes, prefix_rows):
    """Nodes with the hash of their handle and of their name, the prefix one turn longer
    than the parent's extent; both are prefixes of a string through the node."""
    nodes = nodes.withColumns({"f": F.expr(two_fattest("pd", "depth")), "named": F.col("pd") + 1})
    return _at(
        prefix_rows, _at(prefix_rows, nodes, "f", fa="ha", fb="hb"), "named",
        na="ha", nb="hb", pa="pa", pb="pb", above="before",
    ).drop("named")


def write_prefixes(rows, n_rows):
    """The prefixes as a table in buckets of ``conv_id, depth``; a row each, so buckets
    are even whatever the lengths of strings."""
    spark = rows.sparkSession
    buckets = max(spark.sparkContext.defaultParallelism, n_rows // BUCKET_ROWS)
    name = f"prefixes_{uuid.uuid4().hex}"
    dealt = rows.repartition(buckets, "conv_id", "depth")
    writer = dealt.write.format("parquet").option("path", new_path(spark, "prefixes"))
    writer.bucketBy(buckets, "conv_id", "depth").sortBy("conv_id", "depth").saveAsTable(name)
    table = spark.table(name)
    # The files stay, and what has been read of the catalogue goes on with them.
    spark.sql(f"DROP TABLE {name}")
    return table


def exit_nodes(trie, prefix_rows, strings, longest):
    """Where each string leaves the trie: ``a``, the depth of the deepest node that is a
    prefix of it, and the node whose edge it enters from there, if any (``ed, eha, ehb``
    its extent, ``owner`` a string through it)."""
    by_handle = trie.select("f", F.col("fa").alias("ha"), F.col("fb").alias("hb"), *_as_hit())
    zero = F.lit(0).cast("long")
    active = strings.select(
        "conv_id", "length", zero.alias("a"), F.col("length").alias("b"),
        *[zero.alias(c) for c in ("hd", "hha", "hhb", "hpd", "howner")],
    )
    columns, found = active.columns, []
    # Each probe leaves less than the numbers below a power of two: as many rounds as bits.
    for _ in range(int(longest).bit_length()):
        probe = active.withColumn("f", F.expr(two_fattest("a", "b")))
        probe = _at(prefix_rows, probe, "f", ha="ha", hb="hb")
        probe = probe.join(by_handle, ["f", "ha", "hb"], "left")
        hit = F.col("nd").isNotNull()
        probe = probe.withColumns({h: F.coalesce(n, h) for h, n in zip(columns[4:], _HIT)})
        probe = probe.withColumns(
            {"a": F.when(hit, F.col("nd")).otherwise(F.col("a")), "b": F.when(hit, F.col("b")).otherwise(F.col("f") - 1)}
        )
        step = cut_lineage(probe.select(columns))
        found.append(step.where("a >= b"))
        active = step.where("a < b")
    done = reduce(lambda x, y: x.union(y), [*found, active])
    done = done.select("conv_id", "length", *columns[4:])
    # The extent of the last node found is compared only now; a string that does not
    # have it leaves inside that node's edge.
    whole = done.join(
        prefix_rows.select("conv_id", F.col("depth").alias("hd"), F.col("ha").alias("hha"), F.col("hb").alias("hhb"), F.lit(True).alias("same")),
        ["conv_id", "hd", "hha", "hhb"], "left",
    )
    inside = whole.where("same IS NULL").select(
        "conv_id", F.col("hpd").alias("a"), F.col("hd").alias("ed"), F.col("hha").alias("eha"), F.col("hhb").alias("ehb"), F.col("howner").alias("owner")
    )
    beyond = whole.where("same").select("conv_id", F.col("hd").alias("a"), (F.col("hd") + 1).alias("named"))
    beyond = beyond.join(
        prefix_rows.select("conv_id", F.col("depth").alias("named"), F.col("ha").alias("na"), F.col("hb").alias("nb")),
        ["conv_id", "named"], "left",
    )
    by_name = trie.select(
        F.col("pd").alias("a"), "na", "nb", F.col("depth").alias("ed"), F.col("ha").alias("eha"), F.col("hb").alias("ehb"), F.col("conv_id").alias("owner")
    )
    beyond = beyond.join(by_name, ["a", "na", "nb"], "left")
    return cut_lineage(inside.unionByName(beyond.select(inside.columns)))


_HIT = ["nd", "nha", "nhb", "npd", "nowner"]


def _as_hit():
    return [F.col(c).alias(n) for c, n in zip(["depth", "ha", "hb", "pd", "conv_id"], _HIT)]


def insert(trie, prefix_rows, strings, batch, longest):
    """The trie with a batch of strings that it did not have.

    ``trie`` is None or a table of nodes: extent ``depth, ha, hb``, ``conv_id`` of a
    string through it, ``pd`` the depth of its parent's extent, handle and name. The
    root is not in it.
    """
    here = prefix_rows.where(F.col("batch") == batch)
    if trie is None:
        paths = here.withColumns({"a": F.lit(0).cast("long"), "ends": F.col("depth") == F.col("length")})
    else:
        exits = exit_nodes(trie, prefix_rows, strings.where(F.col("batch") == batch), longest)
        paths = here.join(exits.select("conv_id", "a"), "conv_id").withColumn("ends", F.col("depth") == F.col("length"))
        edges = exits.where("ed IS NOT NULL").select("a", "ed", "eha", "ehb", F.col("owner").alias("conv_id")).distinct()
        edges = cut_lineage(edges)
        old = prefix_rows.join(edges, "conv_id").where("depth > a AND depth <= ed")
        old = old.withColumn("ends", F.col("depth") == F.col("ed"))
        paths = paths.unionByName(old.select(paths.columns))
    columns = ["conv_id", "a", "ends", *NODE, "pa", "pb"]
    paths = cut_lineage(paths.where("depth > a").select(columns))
    after = F.struct("ha", "hb")
    parting = (
        paths.where("depth - 1 > a")
        .groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("ha"), F.col("pb").alias("hb"))
        .agg(F.min(after).alias("x"), F.max(after).alias("y"))
        .where("x <> y")
    )
    explicit = parting.select(NODE).union(paths.where("ends").select(NODE)).distinct()
    along = W.partitionBy("conv_id", "a").orderBy("depth")
    nodes = paths.join(explicit, NODE).withColumn("pd", F.coalesce(F.lag("depth").over(along), F.col("a")))
    nodes = nodes.groupBy(NODE).agg(F.min("conv_id").alias("conv_id"), F.max("pd").alias("pd"))
    nodes = _with_handles(nodes, prefix_rows)
    if trie is not None:
        gone = edges.select(F.col("ed").alias("depth"), F.col("eha").alias("ha"), F.col("ehb").alias("hb"))
        nodes = trie.join(gone, NODE, "left_anti").unionByName(nodes)
    return cut_lineage(nodes)


# -- figures of the nodes --------------------------------------------------------


def ends_digests(members):
    """``depth, ha, hb, ends_sha256`` of the ids of equal conversations, in order.

    Ids are joined in pieces of a range of ids each, so a large group is put together by
    many tasks; a digest itself can only be taken in order, by one task, which holds one
    piece at a time.
    """
    pieces = members.groupBy(*NODE, F.expr(f"conv_id div {IDS} - CAST(conv_id < 0 AS INT)").alias("piece")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids")
    )
    pieces = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "piece")

    def digest(batches):
        key, state = None, None
        for batch in batches:
            out = []
            for row in zip(*[batch.column(c).to_pylist() for c in (*NODE, "ids")]):
                if row[:3] != key:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = row[:3], hashlib.sha256()
                else:
                    state.update(b",")
                state.update(row[3].encode())
            yield {c: [row[i] for row in out] for i, c in enumerate(schema)}
        if key is not None:
            yield dict(zip(schema, [[x] for x in (*key, state.hexdigest())]))

    schema = [*NODE, "ends_sha256"]
    kinds = "depth long, ha long, hb long, ends_sha256 string"
    return iterate_batches(pieces.select(*NODE, "ids"), digest, kinds)


def node_figures(trie, prefix_rows, strings):
    """``n_convs, n_children, n_leaves, saved`` and the smallest member of each node of
    the compacted trie, the root included.

    Every figure is a sum over the strings through a node. The words of the distinct
    nodes below it are such a sum as well: each node counts for its smallest member,
    which owns all of its own path from some depth on.
    """
    zero = F.lit(0).cast("long")
    through = prefix_rows.where("depth > 0").select("conv_id", *NODE, "before").join(trie.select(NODE), NODE)
    rooted = strings.select("conv_id", *[zero.alias(c) for c in (*NODE, "before")])
    through = cut_lineage(rooted.unionByName(through))
    mult = strings.select("conv_id", "mult")
    counted = through.join(mult, "conv_id").groupBy(NODE).agg(
        F.min("conv_id").alias("member"), F.sum("mult").alias("n_convs")
    )
    children = trie.groupBy(F.col("pd").alias("depth"), F.col("pa").alias("ha"), F.col("pb").alias("hb")).agg(
        F.count(F.lit(1)).alias("n_children")
    )
    root = strings.limit(1).select(*[zero.alias(c) for c in NODE], F.lit(-1).cast("long").alias("pd"), *[zero.alias(c) for c in ("pa", "pb", "above")])
    nodes = trie.select(*NODE, "pd", "pa", "pb", "above").unionByName(root)
    nodes = nodes.join(counted, NODE).join(children, NODE, "left").na.fill(0, ["n_children"])
    nodes = cut_lineage(nodes)
    owned = nodes.groupBy(F.col("member").alias("conv_id")).agg(
        F.min("pd").alias("opd"), F.min("above").alias("oabove")
    )
    leaves = nodes.where("n_children = 0").select(*NODE, F.lit(1).cast("long").alias("leaf"))
    whole = strings.withColumnRenamed("length", "depth").join(leaves, NODE, "left").join(owned, "conv_id", "left")
    whole = whole.select("conv_id", "mult", "total", F.coalesce("leaf", zero).alias("leaf"), "opd", "oabove")
    own = F.when(F.col("opd").isNull(), zero).otherwise(
        F.col("total") - F.when(F.col("depth") > F.col("opd"), F.col("before")).otherwise(F.col("oabove"))
    )
    sums = through.join(whole, "conv_id").groupBy(NODE).agg(
        F.sum("leaf").alias("n_leaves"),
        F.sum(F.col("mult") * (F.col("total") - F.col("before")) - own).alias("saved"),
    )
    return nodes.join(sums, NODE)


def expand(nodes, prefix_rows):
    """Every depth of every edge as a node: those above an edge's lower end have its
    members, one child, and save what the edge's turns from there on save besides."""
    lower = nodes.join(prefix_rows.select(F.col("conv_id").alias("member"), "depth", F.col("before").alias("end_before")), ["member", "depth"])
    edges = lower.where("depth - pd > 1").withColumn(
        "part", F.explode(F.expr(f"sequence(0L, (depth - pd - 2) div {CHUNK})"))
    )
    inner = edges.withColumn(
        "at", F.explode(F.expr(f"sequence(pd + 1 + part * {CHUNK}, least(depth - 1, pd + (part + 1) * {CHUNK}))"))
    )
    inner = inner.join(prefix_rows.select(F.col("conv_id").alias("member"), F.col("depth").alias("at"), F.col("before").alias("at_before")), ["member", "at"])
    inner = inner.select(
        F.col("member").alias("conv_id"),
        F.col("at").alias("depth"),
        F.when(F.col("at") == F.col("pd") + 1, F.col("parent")).otherwise(F.col("member")).alias("parent_conv_id"),
        "n_convs",
        F.lit(1).cast("long").alias("n_children"),
        "n_leaves",
        (F.col("saved") + (F.col("n_convs") - 1) * (F.col("end_before") - F.col("at_before"))).alias("saved_tokens"),
        F.lit(NOTHING).alias("ends_sha256"),
    )
    low = nodes.select(
        F.col("member").alias("conv_id"), "depth",
        F.when(F.col("depth") - F.col("pd") > 1, F.col("member")).otherwise(F.col("parent")).alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"),
    )
    return low.unionByName(inner)


def prefix_trie(rows, batches=BATCHES):
    """Nodes of the trie of conversations given as turns numbered from 1, with a row of
    depth 0 for each: the smallest member, depth, the parent's smallest member, members,
    children, childless nodes below, words that sharing saves below, and the SHA-256 of
    the ids of the members that end there."""
    members = cut_lineage(whole_strings(rows))
    strings = members.groupBy(NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("mult"), F.first("total").alias("total")
    )
    strings = strings.withColumnRenamed("depth", "length").withColumn(
        "batch", F.pmod(F.xxhash64("ha", "hb"), F.lit(batches))
    )
    strings = cut_lineage(strings)
    longest, n_rows = strings.agg(F.max("length"), F.sum(F.col("length") + 1)).first()
    longest = longest or 0
    prefix_rows = write_prefixes(prefixes(rows, strings), n_rows or 0)
    # The empty string ends at the root, which every trie has.
    worded = strings.where("length > 0")
    trie = None
    for batch in range(batches):
        trie = insert(trie, prefix_rows, worded, batch, longest)
    nodes = cut_lineage(node_figures(trie, prefix_rows, strings))
    parents = nodes.where("depth > 0").select(
        F.col("depth").alias("pd"), F.col("ha").alias("pa"), F.col("hb").alias("pb"), F.col("member").alias("parent")
    )
    # One row, sent to the many children of the root.
    smallest = nodes.where("depth = 0").select(F.col("depth").alias("pd"), F.col("member").alias("parent"))
    at_root = nodes.join(F.broadcast(smallest), "pd")
    others = nodes.where("pd > 0").join(parents, ["pd", "pa", "pb"])
    first = nodes.where("depth = 0").withColumn("parent", F.lit(None).cast("long"))
    nodes = first.unionByName(at_root.select(first.columns)).unionByName(others.select(first.columns))
    nodes = nodes.join(ends_digests(members.select("conv_id", *NODE)), NODE, "left")
    return expand(cut_lineage(nodes), prefix_rows)


def conversation_nodes(conversations, batches=BATCHES):
    """The trie of all rebuilt conversations, one row a node.

    Rows without a conv_id take no part; a null role or text is empty; turns with equal
    numbers are ordered by role and text, repeated rows all count; without rows the
    result is empty. Extra columns are ignored.
    """
    turns = cut_lineage(number_turns(conversations))
    return prefix_trie(cut_lineage(rebuild(turns)), batches)
