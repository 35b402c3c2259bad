"""A Merkle manifest of a table, with a proof for each row found by coordinate lookups; DataFrame functions throughout.

A row's leaf is the SHA-256 of its id, source, language, length and text, each ``-`` if null, else its UTF-8 byte count,
``:`` and the value. Digests are lowercase hex text; a node is the digest of its children's texts in order. The rows of
a source form a tree in order of id (equal ids: of leaf); every ``FAN`` consecutive nodes have a parent, until one is left. The trees' tops,
in order of source (null first), form the last tree, whose top is the manifest's root.

A node's coordinates are (tree, level, place). Places come from a range shuffle by (source, id) and prefix sums of what each
partition has of each source, so a source of any share of the rows is spread over partitions. Levels are built ``TIER`` at
once from groups of FAN ** TIER consecutive nodes, and the node table is written. For a proof, a leaf's coordinates at
the levels of its tier follow from its place and its tree's size; they are exploded to the coordinates of the siblings,
joined with the node table, ordered and concatenated. Siblings above a tier are those of all leaves below one node, so
nodes look them up tier by tier from the root down, and no upper node is asked for by all leaves. Folding goes through
the levels of a proof with the row's digest between what stands before and behind it.

Edge cases: null ids come first in their source and have proofs as all rows; rows that repeat are leaves of their own;
a null or empty text is told apart in the leaf; a lone leaf is its source's subroot, a lone source's subroot the root (its
proof is the digest of nothing); an empty table gives no rows. Only the five columns are read, so others cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import cut, drop

FAN = 3
TIER = 4
BUNCH = FAN**TIER
POWERS = [FAN**k for k in range(39)]


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _sha(text: Column) -> Column:
    """A digest as 32 bytes: half of its text, which hardly compresses."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _hex(digests: Column) -> Column:
    """The text of one digest, or of several in a row."""
    return F.lower(F.hex(digests))


def leaf(text: Column) -> Column:
    """The digest of a row of ``documents`` with this text."""
    return _sha(F.concat(*map(_field, (F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text))))


def _levels(n: Column) -> Column:
    """Levels above n nodes: how often n becomes ceil(n / FAN) until it is 1."""
    return F.size(F.filter(F.lit(POWERS), lambda p: p < n))


def _steps(k: Column) -> Column:
    return F.element_at(F.lit(POWERS), k + 1)


def numbered(rows: DataFrame, group: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with part and seq, written; pieces: group, part, base, n). A row's place in its group is seq - base.

    Rows are dealt in ranges, so a group of any size lies in many partitions, and numbered as they lie. A piece is a partition's share of a
    group: there are no more than partitions and groups together.
    """
    dealt = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    told = cut(dealt.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("seq")), "numbered")
    pieces = told.groupBy(group, "part").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("own"))
    line = Window.partitionBy(group).orderBy("part")
    before = F.coalesce(F.sum("own").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return told, pieces.select(group, "part", (F.col("first") - before).alias("base"), F.sum("own").over(Window.partitionBy(group)).alias("n"))


def _up(digests: Column) -> Column:
    """The next level of nodes that stand side by side."""
    return F.transform(F.sequence(F.lit(0), F.size(digests) - 1, F.lit(FAN)), lambda at: _sha(F.array_join(F.transform(F.slice(digests, at + 1, FAN), _hex), "")))


def tiers(leaves: DataFrame, most: int) -> list[DataFrame]:
    """The nodes above ``leaves`` (tree, place, n, digest), TIER levels a table, written: tree, bunch, n (of its lowest level in
    the whole tree), levels (an array of digests for each of its levels and, last, what is above). ``most`` is the largest n."""
    out, units = [], leaves.select("tree", "place", "n", "digest")
    while True:
        grouped = units.groupBy("tree", F.floor(F.col("place") / BUNCH).alias("bunch")).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("place", "digest"))).alias("all"))
        lowest = grouped.select("tree", "bunch", "n", F.array(F.col("all.digest")).alias("levels"))
        count = F.least(F.lit(TIER), _levels(F.col("n")))
        rounds = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
        built = F.aggregate(rounds, F.col("levels"), lambda known, _: F.concat(known, F.array(_up(F.element_at(known, -1)))))
        out.append(cut(lowest.withColumn("levels", built), "nodes"))
        if most <= BUNCH:
            return out
        most = -(-most // BUNCH)
        units = out[-1].where(F.col("n") > BUNCH).select("tree", F.col("bunch").alias("place"), F.ceil(F.col("n") / BUNCH).alias("n"), _top().alias("digest"))


def _top() -> Column:
    return F.element_at(F.element_at("levels", -1), 1)


def tops(nodes: list[DataFrame]) -> DataFrame:
    """tree, digest: what is left of each tree."""
    own = [t.where(F.col("n") <= BUNCH).select("tree", _top().alias("digest")) for t in nodes]
    out = own[0]
    for more in own[1:]:
        out = out.unionByName(more)
    return out


def lookups(units: DataFrame, nodes: DataFrame) -> DataFrame:
    """tree, place, n, path: for ``units`` (tree, place, n) of a tier's lowest level, a step (before, behind) for each of the
    tier's levels, with the siblings' digests found by their coordinates in its node table."""
    k, place, n = F.col("k"), F.col("place"), F.col("n")
    count = F.least(F.lit(TIER), _levels(n))
    rounds = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))

    def siblings(level):
        own, size = F.floor(place / _steps(level)), F.ceil(n / _steps(level))
        first = F.floor(own / FAN) * FAN
        near = F.transform(F.sequence(F.lit(0), F.lit(FAN - 1)), lambda j: F.struct(level.alias("k"), (first + j).alias("at")))
        return F.filter(near, lambda x: (x["at"] != own) & (x["at"] < size))

    asked = units.select("tree", "place", "n", F.explode_outer(F.flatten(F.transform(rounds, siblings))).alias("s")).select("tree", "place", "n", "s.k", "s.at")
    # the last array of a bunch is what stands above it: no level of this tier
    each = nodes.select("tree", "bunch", F.posexplode(F.slice("levels", F.lit(1), F.size("levels") - 1)).alias("k", "digests"))
    table = each.select("tree", F.col("k"), F.posexplode("digests").alias("j", "digest"), "bunch").select("tree", "k", (F.col("bunch") * F.floor(F.lit(BUNCH) / _steps(k)) + F.col("j")).alias("at"), "digest")
    found = asked.join(table, ["tree", "k", "at"], "left")
    one = F.when(F.col("digest").isNotNull(), F.struct("k", "at", "digest"))
    gathered = found.groupBy("tree", "place", "n").agg(F.sort_array(F.collect_list(one)).alias("s"))

    def step(level):
        own = F.floor(place / _steps(level))
        part = lambda test: F.aggregate(F.filter("s", lambda x: (x["k"] == level) & test(x["at"])), F.lit(bytearray()), lambda a, x: F.concat(a, x["digest"]))
        return F.struct(part(lambda at: at < own).alias("before"), part(lambda at: at > own).alias("behind"))

    return gathered.select("tree", "place", "n", F.transform(rounds, step).alias("path"))


def paths(units: DataFrame, nodes: list[DataFrame], above: DataFrame | None) -> tuple[DataFrame, list[DataFrame]]:
    """(tree, place, path: all steps from the leaf up; what was written on the way).

    From the top tier down, each unit's own steps go in front of those of the node above it; a tree's last tier is followed by ``above``
    (tree, path), the way from its top on.
    """
    written: list[DataFrame] = []
    upper = None
    for t in range(len(nodes) - 1, -1, -1):
        own = units if t == 0 else nodes[t - 1].where(F.col("n") > BUNCH).select("tree", F.col("bunch").alias("place"), F.ceil(F.col("n") / BUNCH).alias("n"))
        told = lookups(own.select("tree", "place", "n"), nodes[t]).withColumn("bunch", F.floor(F.col("place") / BUNCH))
        # where a tree ends in this tier it has one bunch: its way on is that of the tree
        ends = None if above is None else above.select("tree", F.lit(0).cast("long").alias("bunch"), F.col("path").alias("rest"), F.lit(True).alias("last"))
        more = None if upper is None else upper.select("tree", F.col("place").alias("bunch"), F.col("path").alias("rest"), F.lit(False).alias("last"))
        ways = ends if more is None else more if ends is None else ends.unionByName(more)
        if ways is not None:
            last = F.col("n") <= BUNCH
            told = told.withColumn("last", last).join(ways, ["tree", "bunch", "last"], "left").withColumn("path", F.concat("path", F.coalesce("rest", F.array().cast(told.schema["path"].dataType))))
        told = told.select("tree", "place", "path")
        if t:
            told = cut(told, "paths")
            written.append(told)
        upper = told
    return upper, written


def manifest(documents: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for each row.

    ``tampered`` is the text that a verifier is shown (the row's own by default): folding starts from its leaf.
    """
    shown = F.col("text") if tampered is None else tampered
    rows = documents.select("doc_id", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("key"), leaf(F.col("text")).alias("digest"), leaf(shown).alias("shown"))
    told, pieces = numbered(rows, "key", ["doc_id", "digest"])
    held, by_source = numbered(pieces.select("key", "n").distinct().withColumn("all", F.lit(0)), "all", ["key"])
    sources = cut(held.join(by_source.withColumnRenamed("n", "n_sources"), ["all", "part"]).select("key", (F.col("seq") - F.col("base")).alias("tree"), "n", "n_sources"), "sources")
    most = sources.agg(F.max("n"), F.max("n_sources")).first()
    if most[0] is None:
        return rows.select("doc_id", _hex(F.col("digest")).alias("leaf"), *[F.lit("").alias(c) for c in ("subroot", "root", "proof_sha256", "folded_root")], F.lit(True).alias("verified"))
    trees = pieces.join(sources.select("key", "tree"), "key").select("key", "part", "base", "n", "tree")
    leaves = cut(told.join(trees, ["key", "part"]).select("tree", (F.col("seq") - F.col("base")).alias("place"), "n", "doc_id", "digest", "shown"), "leaves")
    drop(told, held)
    nodes = tiers(leaves, most[0])
    subroots = cut(tops(nodes), "subroots")
    crowns = sources.join(subroots, "tree").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.col("n_sources").alias("n"), "digest")
    crown = tiers(crowns, most[1])
    root = tops(crown).first()["digest"]
    ways, more = paths(crowns, crown, None)
    ways = cut(ways.select(F.col("place").alias("tree"), "path"), "ways")
    found, written = paths(leaves, nodes, ways)
    proven = leaves.join(found, ["tree", "place"]).join(subroots.withColumnRenamed("digest", "subroot"), "tree")
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    folded = F.aggregate("path", _hex(F.col("shown")), lambda own, s: digest(F.concat(_hex(s["before"]), own, _hex(s["behind"]))))
    proof = digest(F.array_join(F.transform("path", lambda s: _hex(F.concat(s["before"], s["behind"]))), ""))
    out = proven.select("doc_id", _hex(F.col("digest")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), F.lit(bytes(root).hex()).alias("root"), proof.alias("proof_sha256"), folded.alias("folded_root"))
    out = cut(out.withColumn("verified", F.col("folded_root") == F.col("root")), "proofs")
    drop(sources, leaves, *nodes, subroots, *crown, ways, *more, *written)
    return out


def tampered() -> Column:
    """The text without its line ends where 2 divides the CRC-32 of the id's digits, else the text."""
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.regexp_replace("text", "\n", "")).otherwise(F.col("text"))


def _oracle(depth: int, crown: int) -> str:
    """DuckDB SQL with ``depth`` levels for a source's tree and ``crown`` for that of the sources."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    digest = lambda text: "sha256(" + " || ".join([*(field(c) for c in ("doc_id", "source", "lang", "n_chars")), field(text)]) + ")"
    # CRC-32 bit by bit: a byte is taken in, then eight steps
    steps = "flatten(list_transform(range(1, strlen(doc_id::VARCHAR) + 1), lambda i: [ascii(substr(doc_id::VARCHAR, i::INT, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    crc = f"xor(list_reduce(list_concat([4294967295::BIGINT], {steps}), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295)"
    parts = [
        f"rows AS (SELECT doc_id, source, {digest('text')} AS leaf, {digest(f'(CASE WHEN {crc} % 2 = 0 THEN replace(text, chr(10), {chr(39) * 2}) ELSE text END)')} AS shown FROM documents)",
        "leaves AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM rows)",
        "a0 AS (SELECT tree, place, leaf AS digest, count(*) OVER (PARTITION BY tree) AS n FROM leaves)",
    ]

    def levels(name: str, top: int) -> None:
        for k in range(1, top + 1):
            parts.append(f"{name}{k} AS (SELECT tree, place // 3 AS place, sha256(string_agg(digest, '' ORDER BY place)) AS digest, any_value((n + 2) // 3) AS n FROM {name}{k - 1} WHERE n > 1 GROUP BY tree, place // 3)")
        for k in range(top):
            part = lambda test: f"coalesce(string_agg(y.digest, '' ORDER BY y.place) FILTER (WHERE y.place {test} x.place), '')"  # noqa: B023, E731
            parts.append(f"{name}s{k} AS (SELECT x.tree, x.place, {part('<')} AS before, {part('>')} AS behind FROM {name}{k} x JOIN {name}{k} y ON x.tree = y.tree AND x.place // 3 = y.place // 3 WHERE x.n > 1 GROUP BY x.tree, x.place)")
        parts.append(f"{name}top AS ({' UNION ALL '.join(f'SELECT tree, digest FROM {name}{k} WHERE n = 1' for k in range(top + 1))})")

    levels("a", depth)
    parts.append("b0 AS (SELECT 0 AS tree, tree AS place, digest, count(*) OVER () AS n FROM atop)")
    levels("b", crown)
    every = [*(("a", k) for k in range(depth)), *(("b", k) for k in range(crown))]
    joins, proof, columns = "", "''", ""
    for name, k in every:
        own, tree = ("l.place", "l.tree") if name == "a" else ("l.tree", "0")
        joins += f" LEFT JOIN {name}s{k} ON {name}s{k}.tree = {tree} AND {name}s{k}.place = {own} // {FAN**k}"
        proof += f" || coalesce({name}s{k}.before || {name}s{k}.behind, '')"
        columns += f", {name}s{k}.before AS {name}{k}x, {name}s{k}.behind AS {name}{k}y"
    parts.append(f"way AS (SELECT l.*, {proof} AS proof{columns} FROM leaves l{joins})")
    last = "way"
    for name, k in every:
        parts.append(f"f{name}{k} AS (SELECT * REPLACE (CASE WHEN {name}{k}x IS NULL THEN shown ELSE sha256({name}{k}x || shown || {name}{k}y) END AS shown) FROM {last})")
        last = f"f{name}{k}"
    return f"""WITH {', '.join(parts)}
SELECT doc_id, leaf, atop.digest AS subroot, btop.digest AS root, sha256(proof) AS proof_sha256, shown AS folded_root, shown = btop.digest AS verified
FROM {last} JOIN atop USING (tree) CROSS JOIN btop"""


ORACLE_SQL = _oracle(10, 5)
