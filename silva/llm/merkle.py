"""A Merkle manifest of a dataset: a root digest over all rows, and for each row the proof that it belongs there.

Rows are leaves of one trie per group (a source), in the order of their ids. A leaf's place is its exact rank in the
group, found without a global sort: ids are cut into digits, and counts by ever shorter prefixes give what lies before each
prefix. The rank's digits in the base of the trie's fanout then name a leaf's path, so all leaves that share a prefix meet and become a
node, several levels at a time, longest prefixes first. Groups' roots are the leaves of one more trie.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.tables import numbered
from .common import stage

FANOUT = 3
#: Levels of the trie that are reduced where their leaves meet: fanout**LEVELS digests at most are one row of a task.
LEVELS = 6
#: Bits of an id's digit, hexadecimal digits of a leaf's: a prefix has 65,536 followers at most.
ID_BITS, LEAF_DIGITS = 16, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of strings that follow each other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_of(*fields: Column) -> Column:
    """The digest of a row: each field as its count of UTF-8 bytes, a colon and the value; a dash for null."""

    def part(field: Column) -> Column:
        value = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return digest(*[part(f) for f in fields])


def group_ranks(rows: DataFrame, group: str, key: str, leaf: str, name: str) -> DataFrame:
    """``rows`` with ``name``, the exact place from 0 of each in its ``group``, and ``_n``, the rows of that group.

    The order is by ``key`` (long, nulls first), then by ``leaf`` (hexadecimal digits); ``group`` isn't null. Counts go up through prefixes: the key with the first digits of
    the leaf, the key, the key without its last digit, and so on. Then each prefix takes, from the top down, what lies before it: a sum over its siblings, 65,536 at
    most whatever the size of a group. A key that very many rows share is split by its leaves. Rows equal in all three are ranked in any order among themselves.
    """
    # the key as an unsigned number with its sign turned, so that prefixes order like keys
    turned = F.coalesce(F.col(key).bitwiseXOR(F.lit(-(1 << 63)).cast("long")), F.lit(0).cast("long"))
    low = rows.select("*", F.col(key).isNotNull().alias("_some"), turned.alias("_bits"), F.substring(leaf, 1, LEAF_DIGITS).alias("_digit"))
    own = [group, "_some", "_bits", "_digit"]
    histogram = stage(low.groupBy(*own).agg(F.count("*").alias("_count")), "histogram")
    levels = [(histogram, own, "_digit", own[:3])]  # a table of counts, its key, the digit that orders siblings, what siblings share
    counts = histogram.groupBy(*own[:3]).agg(F.sum("_count").alias("_count"))
    for _ in range(64 // ID_BITS - 1):
        counts = counts.withColumn("_up", F.shiftrightunsigned("_bits", ID_BITS))
        levels.append((counts, own[:3], "_bits", [group, "_some", "_up"]))
        counts = counts.groupBy(group, "_some", F.col("_up").alias("_bits")).agg(F.sum("_count").alias("_count"))
    levels.append((counts, own[:3], "_bits", own[:2]))
    levels.append((counts.groupBy(group, "_some").agg(F.sum("_count").alias("_count")), [group, "_some"], "_some", [group]))
    before = levels[-1][0].groupBy(group).agg(F.sum("_count").alias("_n")).withColumn("_before", F.lit(0).cast("long"))
    for table, keys, digit, shared in reversed(levels):
        siblings = Window.partitionBy(*shared).orderBy(digit).rowsBetween(Window.unboundedPreceding, -1)
        placed = table.withColumn("_within", F.coalesce(F.sum("_count").over(siblings), F.lit(0)))
        above = before.withColumnRenamed("_bits", "_up") if "_up" in shared else before
        before = placed.join(above.select(*shared, "_n", "_before"), shared).select(*keys, "_n", (F.col("_before") + F.col("_within")).alias("_before"))
    nth = F.row_number().over(Window.partitionBy(*own).orderBy(leaf)) - 1
    return low.withColumn("_nth", nth).join(before, own).select(*rows.columns, (F.col("_before") + F.col("_nth")).alias(name), "_n")


def _parent(nodes: Column, fanout: int) -> Column:
    """The digests one level up: each of ``fanout`` consecutive ones, fewer at the end."""

    def one(i: Column) -> Column:
        return digest(*[F.coalesce(F.get(nodes, i * fanout + k), F.lit("")) for k in range(fanout)])

    return F.transform(F.sequence(F.lit(0), ((F.size(nodes) - 1) / fanout).cast("int")), one)


def _beside(nodes: Column, at: Column, fanout: int) -> Column:
    """The siblings of the node at a place, as strings to its left and to its right."""
    mine = at % fanout
    run = at - mine

    def side(wanted: Column, k: int) -> Column:
        return F.when(wanted, F.get(nodes, run + k))

    left = F.concat_ws("", *[side(mine > k, k) for k in range(fanout - 1)])
    right = F.concat_ws("", *[side(mine < k, k) for k in range(1, fanout)])
    return F.struct(left.alias("left"), right.alias("right"))


def trie(leaves: DataFrame, group: str, fanout: int = FANOUT, levels: int = LEVELS) -> tuple[list[DataFrame], DataFrame]:
    """The trie of each group over ``leaves`` (group, _rank from 0, _hash, _n, the group's leaves, and what else goes along).

    Returns the tables of blocks, one for each ``levels`` levels from the leaves up, and (group, _hash) with each group's root. A block holds the leaves that share all but
    the last digits of their rank. While a group has several nodes every node goes up, even alone; a lone leaf is its own root.
    """
    width = fanout**levels
    most = leaves.agg(F.max("_n")).first()[0] or 0
    found, nodes = [], leaves
    while True:
        also = [c for c in nodes.columns if c not in (group, "_n")]
        blocks = nodes.groupBy(group, F.expr(f"_rank div {width}").alias("_block")).agg(F.sort_array(F.collect_list(F.struct("_rank", *[c for c in also if c != "_rank"]))).alias("_items"), F.first("_n").alias("_n"))
        deep = reduce(lambda so_far, k: so_far + (F.col("_n") > fanout**k).cast("int"), range(levels), F.lit(0))  # levels up to the group's root, `levels` at most
        blocks = blocks.withColumn("_deep", deep).withColumn("_h0", F.transform("_items", lambda x: x["_hash"]))
        for k in range(levels):
            blocks = blocks.withColumn(f"_h{k + 1}", F.when(F.col("_deep") > k, _parent(F.col(f"_h{k}"), fanout)).otherwise(F.col(f"_h{k}")))
        found.append(stage(blocks, "blocks"))
        nodes = found[-1].select(group, F.col("_block").alias("_rank"), F.get(f"_h{levels}", F.lit(0)).alias("_hash"), F.ceil(F.col("_n") / width).alias("_n"))
        if most <= width:
            return found, nodes.select(group, "_hash")
        most = -(-most // width)


def proofs(found: list[DataFrame], group: str, above: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """All leaves of a trie with ``_path``, the siblings (left, right) of each level up to its group's root and then what ``above`` gives for the group.

    ``above`` has one row per group: the group, ``_path`` and what else is said of it. Each block meets the path of its node, then hands it to its leaves.
    """
    upper = above.withColumn("_block", F.lit(0).cast("long"))
    said = [c for c in above.columns if c not in (group, "_path")]
    for at, blocks in reversed(list(enumerate(found))):

        def whole(item: Column, i: Column) -> Column:
            own = [F.when(F.col("_deep") > k, _beside(F.col(f"_h{k}"), (i / fanout**k).cast("int"), fanout)) for k in range(levels)]
            return F.struct(item.alias("item"), F.filter(F.array(*own), lambda s: s.isNotNull()).alias("own"))

        met = blocks.join(upper.withColumnRenamed("_path", "_upper"), [group, "_block"])
        each = met.select(group, *said, "_upper", F.explode_outer(F.transform("_items", whole)).alias("_each"))  # explode would make the array once more for a filter on its size
        path = F.concat("_each.own", "_upper").alias("_path")
        if at == 0:
            return each.select(group, *said, "_each.item.*", path)
        upper = each.select(group, *said, F.col("_each.item._rank").alias("_block"), path)
    raise ValueError("a trie has at least one table of blocks")


def manifest(docs: DataFrame, id_col: str = "doc_id", fields: tuple[str, ...] = FIELDS, group_col: str = "source", text_col: str = "text", tamper: Column | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, leaf, subroot (its group's root), root, proof_sha256, folded_root and verified.

    A leaf is :func:`leaf_of` of ``fields``; leaves are ordered by id within their group, null ids first, and rows that share an id by leaf; groups
    by the UTF-8 bytes of their name, null first. The proof is all siblings from the leaf to the root. A row is tampered with where ``tamper`` holds (by default where
    2 divides the crc32 of its decimal id): line ends are taken out of its text; a null text stays. ``folded_root`` is what the proof makes of the row as it then is, and
    ``verified`` says whether that is the root. Repeated rows are leaves each. Other columns are ignored. An empty table gives no rows.
    """
    if tamper is None:
        tamper = F.crc32(F.col(id_col).cast("string").cast("binary")) % 2 == 0
    changed = [F.replace(F.col(f), F.lit("\n"), F.lit("")) if f == text_col else F.col(f) for f in fields]
    group = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))  # the null group comes first
    leaves = docs.select(
        group.alias("_group"), F.col(id_col).cast("long").alias("doc_id"), leaf_of(*[F.col(f) for f in fields]).alias("_hash"),
        F.when(tamper & F.contains(F.col(text_col), F.lit("\n")), leaf_of(*changed)).alias("_tampered"),
    )
    leaves = stage(leaves, "leaves")
    ranked = group_ranks(leaves, "_group", "doc_id", "_hash", "_rank")
    found, subroots = trie(ranked, "_group")
    tops = numbered(subroots, ["_group"], "_rank").withColumns({"_all": F.lit(""), "_n": F.lit(subroots.count()).cast("long")})
    upper_found, roots = trie(tops, "_all")
    above = proofs(upper_found, "_all", roots.select("_all", F.col("_hash").alias("root"), F.array().cast("array<struct<left:string,right:string>>").alias("_path")))
    above = stage(above.select("_group", F.col("_hash").alias("subroot"), "root", "_path"), "groups")
    out = proofs(found, "_group", above)
    folded = F.aggregate("_path", F.coalesce("_tampered", "_hash"), lambda node, s: digest(s["left"], node, s["right"]))
    proof = digest(F.array_join(F.transform("_path", lambda s: F.concat(s["left"], s["right"])), ""))
    out = out.select("doc_id", F.col("_hash").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
