"""From target texts to anchor entities and the articles around them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fixed import ANCHOR_LABELS, ARTICLE_LABELS, RETRIEVAL_TYPES
from ..functions.match import strip_quotes
from ..session import cut
from .graph import undirected
from .ranking import dealt, first_k, first_k_distinct
from .reach import next_targets

GRAM = 3
# Words of 64 anchors that a row of a reached set holds at most.
WORDS = 8
ANCHOR = ["anchor_label", "anchor"]
NODE = ["label", "key"]
# Links from which short lists are made in two passes, far ends that are sampled, and the share (one in) of the first pass.
MANY_LINKS, SAMPLED, EARLY = 1_000_000, 10_000, 32


def needle(target: Column, quotes: bool = True) -> Column:
    return F.lower(strip_quotes(target) if quotes else target)


def pieces_of(text: Column, n: int) -> Column:
    """Distinct pieces of ``n`` characters; none when the text is shorter."""
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1))
    pieces = F.transform(starts, lambda i: F.substr(text, i, F.lit(n)))
    return F.array_distinct(F.coalesce(pieces, F.array().cast("array<string>")))


def match_substring(names: DataFrame, needles: DataFrame) -> DataFrame:
    """Pairs of ``needle`` and name where the lower-cased ``key`` contains the needle.

    An equi-join instead of a comparison of everything with everything: a name can only contain
    a needle if it contains each three-letter piece of it, so both sides meet on the rarest
    piece of the needle, and the full text decides. Names keep only pieces that some needle has;
    these are written once, counted, and joined. Adaptive execution splits a piece that very many
    names hold. Needles of one or two letters are their own piece; without any, those pieces are
    not made.
    """
    low = names.withColumn("_low", F.lower("key"))
    wanted = needles.select("needle").filter(F.col("needle").isNotNull()).distinct()

    def held(pieces: Column, used: DataFrame) -> DataFrame:
        made = low.select(*names.columns, "_low", F.explode(pieces).alias("gram"))
        return made.join(used.select("gram").distinct(), "gram", "left_semi")

    def meet(sides: DataFrame, keys: DataFrame) -> DataFrame:
        joined = sides.join(keys, "gram").filter(F.contains("_low", F.col("needle")))
        return joined.select("needle", *names.columns)

    long = wanted.filter(F.length("needle") >= GRAM)
    pieces = long.select("needle", F.explode(pieces_of(F.col("needle"), GRAM)).alias("gram"))
    sides = cut(held(pieces_of(F.col("_low"), GRAM), pieces), "pieces")
    counts = sides.groupBy("gram").agg(F.count(F.lit(1)).alias("names"))
    rarest = (
        pieces.join(counts, "gram", "left")
        .groupBy("needle")
        .agg(F.min_by("gram", F.struct(F.coalesce("names", F.lit(0)), "gram")).alias("gram"))
    )
    found = meet(sides, rarest)
    short = wanted.filter(F.length("needle") < GRAM).select("needle", F.col("needle").alias("gram"))
    if short.isEmpty():
        return found
    one_or_two = F.concat(F.array(F.lit("")), pieces_of(F.col("_low"), 1), pieces_of(F.col("_low"), 2))
    return found.unionByName(meet(held(one_or_two, short), short))


def resolve_targets(
    targets: DataFrame,
    nodes: DataFrame,
    labels: list[str] = ANCHOR_LABELS,
    quotes: bool = True,
) -> DataFrame:
    """Anchor entities of every target: ``target_id, target, anchor_label, anchor``."""
    asked = targets.withColumn("needle", needle(F.col("target"), quotes))
    found = match_substring(nodes.filter(F.col("label").isin(labels)).select(*NODE), asked)
    return asked.join(found, "needle").select(
        "target_id", "target", F.col("label").alias("anchor_label"), F.col("key").alias("anchor")
    )


def _links(edges: DataFrame, rel_types: list[str]) -> DataFrame:
    return undirected(edges.filter(F.col("rel_type").isin(rel_types))).select(
        "near_label", "near", "far_label", "far"
    )


def _numbered(anchors: DataFrame) -> DataFrame:
    """Every anchor once, with a short number that stands for it in the reached sets.

    Sorted, so that anchors of one label share blocks: a hub's walk over most of the graph is made once for its block.
    """
    once = anchors.select(*ANCHOR).distinct().orderBy(*ANCHOR)
    return cut(once.withColumn("anchor_id", F.monotonically_increasing_id()), "anchors")


def _start(numbered: DataFrame) -> DataFrame:
    return numbered.select(
        "anchor_id", F.col("anchor_label").alias("label"), F.col("anchor").alias("key"),
        F.lit(0).alias("hop"),
    )


def _step(frontier: DataFrame, links: DataFrame, hop: int) -> DataFrame:
    return frontier.join(
        links,
        (F.col("label") == F.col("near_label")) & (F.col("key") == F.col("near")),
    ).select(
        "anchor_id", F.col("far_label").alias("label"), F.col("far").alias("key"),
        F.lit(hop).alias("hop"),
    )


def _settle(rows: DataFrame) -> DataFrame:
    """Shortest distance of every reached node. One aggregate replaces distinct and anti join,
    and it combines the many paths to a node before the shuffle."""
    return rows.groupBy("anchor_id", *NODE).agg(F.min("hop").alias("hop"))


def _check(hops: int) -> None:
    if not 1 <= hops <= 5:
        raise ValueError("hops must be from 1 to 5")


def _any(words: list[str]) -> Column:
    return reduce(Column.bitwiseOR, [F.col(w) for w in words]) != 0


def _merge(rows: DataFrame, seen: list[str], fresh: list[str]) -> DataFrame:
    """Reached nodes with ``seen``, anchors so far, and ``fresh``, anchors that are new; rows hold new ones in ``fresh``."""
    merged = rows.groupBy("block", *NODE).agg(*[F.bit_or(c).alias(c) for c in (*seen, *fresh)])
    return merged.select(
        "block", *NODE,
        *[F.col(s).bitwiseOR(F.col(f)).alias(s) for s, f in zip(seen, fresh, strict=True)],
        *[F.col(f).bitwiseAND(F.bitwise_not(s)).alias(f) for s, f in zip(seen, fresh, strict=True)],
    )


def _walk(
    links: DataFrame, numbered: DataFrame, hops: int, target_labels: list[str], words: int, whole: bool = False
) -> tuple[list[DataFrame], DataFrame]:
    """Target nodes per block of anchors with the anchors that reach them at a distance: ``block, label, key, hop`` and
    ``fresh0``, ``fresh1`` and so on, 64 anchors each; one table per distance. And what is reached, which holds all nodes and is
    written if it is ``whole``; else the last step goes to targets only."""
    is_target = F.col("label").isin(target_labels)
    none = F.lit(0).cast("bigint")
    seen, fresh = [f"seen{i}" for i in range(words)], [f"fresh{i}" for i in range(words)]
    bit = F.expr("shiftleft(1L, cast(anchor_id % 64 as int))")
    word = F.expr(f"anchor_id div 64 % {words}")
    reached = numbered.select(
        F.expr(f"anchor_id div {64 * words}").alias("block"),
        F.col("anchor_label").alias("label"),
        F.col("anchor").alias("key"),
        *[F.when(word == i, bit).otherwise(none).alias(c) for names in (seen, fresh) for i, c in enumerate(names)],
    )
    found = []
    for hop in range(1, hops + 1):
        last = hop == hops and not whole
        # Links that start at other labels need not be looked up.
        labels = [r["label"] for r in reached.filter(_any(fresh)).select("label").distinct().collect()]
        usable = links.filter(F.col("near_label").isin(labels))
        if last:
            usable = usable.filter(F.col("far_label").isin(target_labels))
        kept = reached.filter(is_target) if last else reached
        step = (
            reached.filter(_any(fresh))
            .join(usable, (F.col("label") == F.col("near_label")) & (F.col("key") == F.col("near")))
            .select(
                "block", F.col("far_label").alias("label"), F.col("far").alias("key"),
                *[none.alias(c) for c in seen], *fresh,
            )
        )
        kept = kept.select("block", *NODE, *seen, *[none.alias(c) for c in fresh])
        reached = _merge(kept.unionByName(step), seen, fresh)
        if not last:
            reached = cut(reached, f"hop{hop}")
        found.append(reached.filter(is_target & _any(fresh)).select("block", *NODE, F.lit(hop).alias("hop"), *fresh))
    return found, reached


def expand(
    edges: DataFrame,
    anchors: DataFrame,
    hops: int = 3,
    rel_types: list[str] = RETRIEVAL_TYPES,
    target_labels: list[str] = ARTICLE_LABELS,
    counted: bool = False,
) -> DataFrame:
    """Every target node within ``hops`` undirected steps of an anchor, with its distance.

    Anchors travel in blocks of up to 512, each one bit of a row's words, so a node is joined and counted
    once per block and not once per anchor, and the many paths to a node fall together in a
    partial ``bit_or`` before the shuffle. The reached set is written after each hop. ``edges``
    should be a stored table, it is read once per hop.

    ``counted`` gives per anchor and distance the number of target nodes and their first and last key instead,
    ``targets, first_key, last_key``. These are told from the words, without a row per anchor and node; the last step, which
    reaches most, is told by parts of the targets (``reach.next_targets``).
    """
    _check(hops)
    numbered = _numbered(anchors)
    words = min(WORDS, -(-numbered.count() // 64) or 1)
    links = _links(edges, rel_types)
    if counted:
        found, reached = _walk(links, numbered, hops - 1, target_labels, words, whole=True)
        is_target, to_target = F.col("label").isin(target_labels), F.col("far_label").isin(target_labels)
        counts = next_targets(links.filter(to_target), reached, is_target, edges.count(), words)
        counts = counts.withColumn("hop", F.lit(hops))
        if found:
            counts = counts.unionByName(_tally(reduce(DataFrame.unionByName, found), words))
        return counts.join(numbered, "anchor_id").select(*ANCHOR, "hop", "targets", "first_key", "last_key")
    found = reduce(DataFrame.unionByName, _walk(links, numbered, hops, target_labels, words)[0])
    bits = F.concat(*[_set_bits(f"fresh{w}", 64 * w) for w in range(words)])
    return (
        found.select("block", *NODE, "hop", F.explode(bits).alias("bit"))
        .select((F.col("block") * (64 * words) + F.col("bit")).alias("anchor_id"), *NODE, "hop")
        .join(numbered, "anchor_id")
        .select(*ANCHOR, *NODE, "hop")
    )


def _set_bits(word: str, first: int) -> Column:
    """The places of a word's set bits, counted from ``first``. Bytes without any, and most words are zero, are not looked into."""
    by_byte = ", ".join(f"array({', '.join(str(i) for i in range(8) if b >> i & 1)})" for b in range(256))
    return F.expr(
        f"if({word} = 0, cast(array() as array<int>), flatten(transform(filter(sequence(0, 56, 8), b -> "
        f"(shiftrightunsigned({word}, b) & 255) != 0), b -> transform(element_at(array({by_byte}), "
        f"cast(shiftrightunsigned({word}, b) & 255 as int) + 1), i -> i + b + {first}))))"
    )


def _tally(found: DataFrame, words: int) -> DataFrame:
    """``anchor_id, hop, targets, first_key, last_key`` of rows of :func:`_walk`.

    Every task adds up the bits of its rows, a block and distance at a time, and gives one row per anchor and distance.
    """
    names = [f"fresh{i}" for i in range(words)]
    schema = T.StructType.fromDDL("anchor_id bigint, hop int, targets bigint, first_key string, last_key string")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, count, first, last = None, None, None, None

        def done() -> pa.RecordBatch:
            held = np.flatnonzero(count)
            return pa.RecordBatch.from_arrays(
                [pa.array(at[0] * 64 * words + held, pa.int64()), pa.array([at[1]] * len(held), pa.int32()),
                 pa.array(count[held], pa.int64()), pa.array(first[held], pa.string()), pa.array(last[held], pa.string())],
                names=["anchor_id", "hop", "targets", "first_key", "last_key"],
            )

        for batch in batches:
            block, hop = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "hop"))
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names], axis=1).astype("<i8")
            no_key = batch.column("key").is_null().to_numpy(zero_copy_only=False)
            groups = np.stack([block, hop, no_key], axis=1)
            starts = np.flatnonzero(np.r_[True, (groups[1:] != groups[:-1]).any(axis=1)]) if len(groups) else []
            for i, j in zip(starts, [*starts[1:], len(groups)], strict=True):
                if at != tuple(groups[i].tolist()):
                    if at is not None:
                        yield done()
                    at, count = tuple(groups[i].tolist()), np.zeros(64 * words, "i8")
                    first, last = np.empty(64 * words, object), np.empty(64 * words, object)
                bits = np.unpackbits(np.ascontiguousarray(rows[i:j]).view("u1"), axis=1, bitorder="little")
                n = bits.sum(axis=0, dtype="i8")
                # Rows come in the order of their keys. Most bits lie in the last rows, the others are looked for in all.
                new, tail = np.flatnonzero((count == 0) & (n > 0)), bits[-32:][::-1]
                first[new] = keys[i + bits[:, new].argmax(axis=0)]
                near = np.flatnonzero(tail.any(axis=0))
                last[near] = keys[j - 1 - tail[:, near].argmax(axis=0)]
                far = np.setdiff1d(np.flatnonzero(n), near, assume_unique=True)
                last[far] = keys[j - 1 - bits[::-1, far].argmax(axis=0)]
                count += n
        if at is not None:
            yield done()

    ordered = found.select("block", "hop", "key", *names).sortWithinPartitions("block", "hop", F.isnull("key"), "key")
    parts = ordered.mapInArrow(add, schema)
    return parts.groupBy("anchor_id", "hop").agg(
        F.sum("targets").alias("targets"), F.min("first_key").alias("first_key"), F.max("last_key").alias("last_key")
    )


def short_list_length(limit: int) -> int:
    """How many of a node's targets :func:`nearest` needs at most."""
    return 2 * limit - 1


def short_lists(
    edges: DataFrame,
    limit: int = 25,
    rel_types: list[str] = RETRIEVAL_TYPES,
    target_labels: list[str] = ARTICLE_LABELS,
) -> DataFrame:
    """The first targets by key next to every node: ``near_label, near, far_label, far``.

    Limited before the shuffle, so a hub sends at most that many rows per task. Write them once where several
    searches share the edges; ``adjacency.ShortLists`` keeps them while edges are added. ``edges`` should be a
    stored table.

    That limit sorts every link. In a large table the links with the least far ends come first: a node that
    has a whole list among these is done, and its other links are not sorted. The share is drawn from a sample, which only
    decides how much is sorted.
    """
    links = _links(edges, rel_types).filter(F.col("far_label").isin(target_labels))
    length, node = short_list_length(limit), ["near_label", "near"]
    total = links.count()
    if total < MANY_LINKS:
        return cut_lists(links, length)
    drawn = links.filter("far is not null").select("far").sample(min(1.0, SAMPLED / total), seed=42)
    ends = sorted(r["far"] for r in drawn.limit(2 * SAMPLED).collect())
    if not ends:
        return cut_lists(links, length)
    first = F.col("far").isNull() | (F.col("far") <= F.lit(ends[len(ends) // EARLY]))
    early = cut(cut_lists(links.filter(first), length), "early-lists")
    whole = early.groupBy(*node).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= length)
    whole = cut(whole.select(*node), "whole-lists")
    # What is left has no hubs, so it is dealt by node before it is sorted, to tasks of about one size.
    rest = cut_lists(dealt(links.join(whole, node, "left_anti"), total, *node), length)
    return early.join(whole, node, "left_semi").select(*rest.columns).unionByName(rest)


def cut_lists(links: DataFrame, length: int) -> DataFrame:
    """The first ``length`` distinct far ends of every near end."""
    return first_k_distinct(links, ["near_label", "near"], [F.col("far"), F.col("far_label")], length).distinct()


def _end_lists(nearby: DataFrame) -> DataFrame:
    """Every node's short list as one sorted array, written: ``label, key, ends``."""
    end = F.struct("far", "far_label")
    rows = nearby.groupBy(F.col("near_label").alias("label"), F.col("near").alias("key"))
    return cut(rows.agg(F.sort_array(F.collect_set(end)).alias("ends")), "ends")


def node_lists(
    edges: DataFrame,
    limit: int = 25,
    rel_types: list[str] = RETRIEVAL_TYPES,
    target_labels: list[str] = ARTICLE_LABELS,
) -> DataFrame:
    """:func:`short_lists` as :func:`nearest` reads them, written."""
    return _end_lists(short_lists(edges, limit, rel_types, target_labels))


def _first_ends(frontier: DataFrame, lists: DataFrame, limit: int, hop: int) -> DataFrame:
    """The targets next to a frontier that can be among an anchor's first ``limit``.

    At most ``limit`` entries of a list were reached before, the anchor itself among them, so a list with an entry at
    ``limit + 1`` fills the anchor up and nothing after that entry can count. A list is joined once its anchor's
    bound is known, so only the entries that count leave the join; lists travel once each, not once per anchor.
    """
    bounds = lists.select(*NODE, F.get("ends", F.lit(limit)).alias("bound")).filter("bound is not null")
    least = frontier.join(cut(bounds, "bounds"), NODE).groupBy("anchor_id").agg(F.min("bound").alias("least"))
    kept = F.filter("ends", lambda e: F.col("least").isNull() | (e <= F.col("least")))
    at = frontier.join(least, "anchor_id", "left").join(lists, NODE)
    ends = at.select("anchor_id", F.explode(kept).alias("end"))
    return ends.select(
        "anchor_id", F.col("end.far_label").alias("label"), F.col("end.far").alias("key"), F.lit(hop).alias("hop")
    )


def nearest(
    edges: DataFrame,
    anchors: DataFrame,
    hops: int = 3,
    limit: int = 25,
    rel_types: list[str] = RETRIEVAL_TYPES,
    target_labels: list[str] = ARTICLE_LABELS,
    nearby: DataFrame | None = None,
) -> DataFrame:
    """The first ``limit`` target nodes of every anchor, by distance and then by key.

    The same answer as :func:`expand` and a rank, for far less work:

    * an anchor that has ``limit`` targets after some hop is finished, since later ones are
      farther away; so hubs stop at once;
    * an unfinished anchor has fewer than ``limit`` targets, so among the targets next to any
      frontier node only the first ``2 * limit - 1`` by key can be among its next ones. A hub met
      on the way adds that many rows, not all its articles;
    * one list of more than ``limit`` entries gives an anchor all that it lacks, so of the other lists in its frontier
      only entries up to that list's are made into rows. A dense hub cuts the lists of all others short.

    ``nearby`` are :func:`short_lists` of these edges, types and labels, for this limit or a larger one, or :func:`node_lists`, which
    several searches can share. Only anchors that lack targets after a hop go on, so nothing is looked up for the others.
    """
    _check(hops)
    links = _links(edges, rel_types)
    to_target = F.col("far_label").isin(target_labels)
    is_target = F.col("label").isin(target_labels)
    numbered = _numbered(anchors)
    reached = _start(numbered)
    if nearby is None:
        nearby = node_lists(edges, limit, rel_types, target_labels)
    lists = nearby if "ends" in nearby.columns else _end_lists(nearby)
    finished = None
    for hop in range(1, hops + 1):
        frontier = reached.filter(F.col("hop") == hop - 1).drop("hop")
        if finished is not None:
            frontier = frontier.join(finished, "anchor_id", "left_anti")
        found = _first_ends(frontier, lists, limit, hop)
        if hop == hops:
            most = reached.filter(F.col("hop") == hop - 1).count() * short_list_length(limit)
            reached = _settle(dealt(reached.filter(is_target).unionByName(found), most, "anchor_id", *NODE))
            break
        known = cut(_settle(reached.unionByName(found)), f"known{hop}")
        counts = known.filter(is_target).groupBy("anchor_id").agg(F.count(F.lit(1)).alias("n"))
        finished = cut(counts.filter(F.col("n") >= limit).select("anchor_id"), "finished")
        going = frontier.join(finished, "anchor_id", "left_anti")
        # Labels are few; edges of others need not be shuffled.
        labels = [r["label"] for r in going.select("label").distinct().collect()]
        if not labels:
            reached = known
            break
        inner = links.filter(~to_target & F.col("near_label").isin(labels))
        reached = cut(_settle(known.unionByName(_step(going, inner, hop))), f"nearest{hop}")
    ends = reached.filter(is_target & (F.col("hop") > 0))
    first = first_k(ends, ["anchor_id"], [F.col("hop"), F.col("key"), F.col("label")], limit)
    return first.join(numbered, "anchor_id").select(*ANCHOR, *NODE, "hop", "rank")
