"""Secret scans with multipart credential linking, in DataFrame and SQL functions only.

Base kinds are found by pattern. Weak candidates (a bare 40-character token, a mail address as account name, an
address or URL as endpoint) mean nothing by themselves; an interval join within a scope of ``SCOPE`` code points
looks for their other parts, and they are reported only where these co-occur:

* ``token``    when an access identifier (``access`` or ``account``) is in scope,
* ``account``  when a secret (``assign``, ``hex`` or ``token``) is in scope,
* ``endpoint`` when both an identifier and a secret are in scope.

The join is a sweep: within a document, parts in order of start meet the nearest part of each role before and behind
them, so a document with many parts costs their number (sorted), not their pairs. Texts may be of any length: places are
running sums over a document's matches, and no list of them is built again for each one.

Edge cases: a null text is empty and has no spans; rows with equal ids, or that repeat, stay rows of their own; a weak
candidate that overlaps a base span is that span and is not reported again; equal starts are in order of kind. Only
the id and text columns are read, so other columns cannot clash. Places are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed patterns and limits: kind, role, pattern, group whose length counts, least length.
KINDS = [
    ("assign", "secret", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", "identifier", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", "secret", r"[0-9a-f]{32,}", 0, 32),
    ("token", "secret", r"(?<![A-Za-z0-9+/=_.-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_.-])", 0, 40),
    ("account", "identifier", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", 0, 6),
    ("endpoint", "endpoint", r"""https?://[^\s"'<>]+|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9.])""", 0, 7),
]
BASE = 3  # so many kinds need no other part
SCOPE = 200


def _sql(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


def _pieces(k: int) -> str:
    """SQL for the matches m{k} of kind k in turn: code points between the match before and it, its own, and the counted ones."""
    _, _, pattern, group, _ = KINDS[k]
    counted = f"regexp_extract_all(text, {_sql(pattern)}, {group})" if group else f"m{k}"
    return f"""CASE WHEN size(m{k}) = 0 THEN cast(array() AS array<struct<skip:int,len:int,n:int,k:int>>) ELSE zip_with(
        zip_with(slice(split(text, {_sql(pattern)}, -1), 1, size(m{k})), m{k}, (a, b) -> named_struct('skip', length(a), 'len', length(b))),
        {counted}, (a, b) -> named_struct('skip', a.skip, 'len', a.len, 'n', length(b), 'k', {k})) END"""


def _parts(df: DataFrame) -> DataFrame:
    """row, doc_id, start, end, order, kind, role: a row for each base span and weak candidate; all null for matches that are too short and
    once for a document without matches. Places are running sums over a document's matches of a kind."""
    source = df.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    matched = source.select("*", *[F.expr(f"regexp_extract_all(text, {_sql(x[2])}, 0)").alias(f"m{k}") for k, x in enumerate(KINDS)])
    pieces = matched.select("row", "doc_id", F.posexplode_outer(F.concat(*[F.expr(_pieces(k)) for k in range(len(KINDS))])).alias("at", "m"))
    dealt = pieces.select("row", "doc_id", "at", "m.*").repartition("row")  # the windows of a kind and of a document need no other shuffle
    end = F.sum(F.col("skip") + F.col("len")).over(Window.partitionBy("row", "k").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    told = dealt.withColumn("end", end).withColumn("long", F.col("n") >= F.element_at(F.array(*[F.lit(x[4]) for x in KINDS]), F.col("k") + 1))
    of = lambda column: F.when(F.col("long"), column)
    named = lambda at: F.element_at(F.array(*[F.lit(x[at]) for x in KINDS]), F.col("k") + 1)
    return told.select("row", "doc_id", of(F.col("end") - F.col("len")).alias("start"), of(F.col("end")).alias("end"), of(F.col("k")).alias("order"), of(named(0)).alias("kind"), of(named(1)).alias("role"))


def find(df: DataFrame) -> DataFrame:
    """A row for each part that is reported, and one with null kind for a document without any.

    row, doc_id, kind, order, start, end, and identifier, secret, endpoint: start of the nearest other part of that
    role within the scope, if there is one.
    """
    flat = _parts(df)
    order = ("start", "order", "end")
    # frames that grow with the rows, one in each direction: a frame that shrinks would be summed anew for every row
    before = Window.partitionBy("row").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("row").orderBy(*map(F.desc, order)).rowsBetween(Window.unboundedPreceding, -1)
    base = F.col("order") < BASE
    swept = flat.withColumn("base_before", F.max(F.when(base, F.col("end"))).over(before)).withColumn("base_behind", F.min(F.when(base, F.col("start"))).over(behind))
    # a weak candidate that overlaps a base span is part of it and takes no part in linking
    near = swept.where(F.col("order").isNull() | base | ((F.coalesce("base_before", F.lit(0)) <= F.col("start")) & (F.coalesce("base_behind", F.col("end")) >= F.col("end"))))
    roles = ("identifier", "secret", "endpoint")
    mine = lambda role: F.col("role") == role
    # the latest end before, and the first start behind; equal roles do not link with themselves
    near = near.select("*", *[F.min(F.when(mine(role), F.col("start"))).over(behind).alias(f"first_{role}") for role in roles])
    near = near.select("*", *[F.max(F.when(mine(role), F.struct("end", "start"))).over(before).alias(f"last_{role}") for role in roles])
    for role in roles:
        first, last = F.col(f"first_{role}"), F.col(f"last_{role}")
        near = near.withColumn(role, F.when(F.col("start") - last["end"] <= SCOPE, last["start"]).otherwise(F.when(first - F.col("end") <= SCOPE, first)))
    has = lambda role: F.col(role).isNotNull()
    linked = F.when(F.col("kind") == "token", has("identifier")).when(F.col("kind") == "account", has("secret")).otherwise(has("identifier") & has("secret"))
    keep = near.withColumn("told", F.col("order").isNull() | (F.col("order") < BASE) | linked)
    blank = lambda c: F.when(F.col("told"), F.col(c)).alias(c)
    return keep.select("row", "doc_id", *[blank(c) for c in ("kind", "order", "start", "end", "identifier", "secret", "endpoint")])


def digests(df: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, and n_linked: weak candidates that are reported."""
    spans = find(df)
    one = F.struct("start", "order", "end", "kind")
    rows = spans.groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(F.when(F.col("kind").isNotNull(), one))).alias("all"))
    count = lambda kind: F.size(F.filter("all", lambda x: x["kind"] == kind)).cast("long")
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("all", lambda x: x["order"] < BASE)
    return rows.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind, *_ in KINDS[:BASE]],
        F.sha2(text(base).cast("binary"), 256).alias("base_sha256"),
        text(F.col("all")).alias("spans"),
        (F.size("all") - F.size(base)).cast("long").alias("n_linked"),
    )
