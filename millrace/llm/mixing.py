"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that list
them). Token capacity flows from patterns to source quotas; the first, second
and third copy of a pattern's tokens cost more and more (a convex cost), so
repetition is spread before it deepens. Each pattern's flow is then filled
with whole documents in a seeded order.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.shared import store

#: Patterns of sources that overlap, whose flow is solved on the driver.
MAX_PATTERNS = 200_000
#: Documents that may still fit, from which on the driver goes through them.
FEW = 50_000
_BUCKET_BITS = 12
_HASH_BITS = 60


def water_fill(sizes: DataFrame, total: int, weights=(1, 2, 3), most: int = 3) -> DataFrame:
    """``_s, _source_size, target`` by source from ``_s, _source_size``.

    A source's weight is the next of ``weights``, repeated, in code point
    order, null last. Targets share out ``total`` by weight and stop at
    ``most`` times a source's size; the excess goes to the others by weight
    until none is above. A source is capped exactly if its cap per weight is
    below the level that the others reach, so one pass in the order of caps
    per weight finds the fixed point. One task orders the sources, a row each.
    """
    place = F.row_number().over(Window.orderBy(F.col("_s").asc_nulls_last())) - 1
    share = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("double")
    rows = sizes.select("_s", "_source_size", share.alias("_w"), (F.col("_source_size") * most).cast("double").alias("_cap"))
    order, every = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("_s").asc_nulls_last()), Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0.0))
    capped = F.col("_cap") * (F.sum("_w").over(every) - level("_w")) <= F.col("_w") * (F.lit(float(total)) - level("_cap"))
    rows = rows.withColumn("_capped", capped)
    rest = F.lit(float(total)) - F.coalesce(F.sum(F.when(F.col("_capped"), F.col("_cap"))).over(every), F.lit(0.0))
    weight = F.sum(F.when(F.col("_capped"), 0.0).otherwise(F.col("_w"))).over(every)
    return rows.select("_s", "_source_size", F.when(F.col("_capped"), F.col("_cap")).otherwise(F.col("_w") * rest / weight).alias("target"))


@dataclass(frozen=True)
class Flow:
    """Tokens by (pattern, source)."""

    tokens: dict

    def by_pattern(self) -> dict:
        out: dict = {}
        for (p, _), n in self.tokens.items():
            out[p] = out.get(p, 0) + n
        return out


def min_cost_flow(capacity: dict, quotas: dict, copies: int = 3) -> Flow:
    """The largest flow from patterns to sources, at least cost.

    ``capacity``: tokens by pattern (a tuple of source keys); a copy's cost
    per token is its number, 1 to ``copies``. ``quotas``: whole tokens by
    source. Only the arcs into patterns cost anything, so a shortest path costs
    what its first arc does: paths that begin with a first copy come first,
    then those with a second one, and so on. Each copy is therefore a largest
    flow of its own (Dinic's blocking flows) on top of the flow so far. Nodes
    are taken in order, so equal input gives equal flow.
    """
    patterns, sources = sorted(capacity, key=repr), sorted(quotas, key=repr)
    at = {s: len(patterns) + i for i, s in enumerate(sources)}
    to: list[int] = []
    left: list[int] = []
    of: list[list[int]] = [[] for _ in range(len(patterns) + len(sources))]
    carried = {}
    for i, p in enumerate(patterns):
        for s in p:
            if s in at:
                carried[p, s] = len(to)
                of[i].append(len(to))
                of[at[s]].append(len(to) + 1)
                to += [at[s], i]
                left += [copies * capacity[p], 0]
    room = {at[s]: n for s, n in quotas.items()}
    for _ in range(copies):
        supply = [capacity[p] for p in patterns]
        while True:
            far = [-1] * len(of)
            queue = deque(i for i, n in enumerate(supply) if n)
            for i in queue:
                far[i] = 0
            reached = False
            while queue:
                u = queue.popleft()
                reached = reached or room.get(u, 0) > 0
                for a in of[u]:
                    if left[a] and far[to[a]] < 0:
                        far[to[a]] = far[u] + 1
                        queue.append(to[a])
            if not reached:
                break
            tried = [0] * len(of)
            for i in range(len(patterns)):
                while supply[i]:
                    path, u = [], i
                    while room.get(u, 0) == 0:
                        while tried[u] < len(of[u]) and not (left[of[u][tried[u]]] and far[to[of[u][tried[u]]]] == far[u] + 1):
                            tried[u] += 1
                        if tried[u] < len(of[u]):
                            path.append(of[u][tried[u]])
                            u = to[path[-1]]
                        elif path:
                            u = to[path.pop() ^ 1]
                            tried[u] += 1
                        else:
                            break
                    if room.get(u, 0) == 0:
                        break
                    n = min([supply[i], room[u], *(left[a] for a in path)])
                    supply[i] -= n
                    room[u] -= n
                    for a in path:
                        left[a] -= n
                        left[a ^ 1] += n
    return Flow({key: left[a ^ 1] for key, a in carried.items() if left[a ^ 1]})


def seeded(seed: int, key: Column) -> Column:
    """Sixty bits of a seeded order."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def _greedy(rows: list) -> list[int]:
    """``_u`` of the documents that fit, one after the other by pattern."""
    order = sorted(rows, key=lambda r: (r["_p"], r["_h"], r["_id"] is not None, r["_id"], r["_size"], r["_u"]))
    taken, rest = [], {r["_p"]: r["_rest"] for r in rows}
    for r in order:
        if r["_size"] <= rest[r["_p"]]:
            rest[r["_p"]] -= r["_size"]
            taken.append(r["_u"])
    return taken


def select_documents(sized: DataFrame, need: DataFrame) -> DataFrame:
    """``sized`` (_id, _pattern, _size, _h, _u and more) with ``_taken``.

    ``need`` (_p, _copies, _rest): by pattern the whole copies of every
    document, and the tokens on top. The latter go to the documents that still
    fit, one after the other in the seeded order, and what then is missing to
    the smallest other one, if that is nearer. Up to the first that doesn't
    fit this is a running sum; then it goes on behind that one, among those
    that are small enough, until none is. Running sums are taken over buckets
    of the order; only the bucket in which a pattern's tokens end is summed by
    document, so that a hot pattern is never ordered in one task. Once at most
    FEW documents may still fit, the driver goes through these.
    """
    key = F.struct("_h", "_id", "_size", "_u")
    kind = dict(sized.select(key.alias("_k")).dtypes)["_k"]
    bucket = F.shiftright("_h", _HASH_BITS - _BUCKET_BITS)
    by_place = Window.partitionBy("_p").orderBy("_h", "_id", "_size", "_u").rowsBetween(Window.unboundedPreceding, 0)
    state, rounds = need.where("_rest > 0").select("_p", "_rest", F.lit(None).cast(kind).alias("_low")), None
    while True:
        state = store(state, "mix-state")
        fits = (F.col("_size") > 0) & (F.col("_size") <= F.col("_rest")) & (F.col("_low").isNull() | (key > F.col("_low")))
        open_ = sized.join(state, F.col("_pattern") == F.col("_p")).where(fits).select("_p", "_rest", "_h", "_id", "_size", "_u")
        sums = store(open_.groupBy("_p", "_rest", bucket.alias("_b")).agg(F.sum("_size").alias("_n"), F.count("*").alias("_rows"), F.max(key).alias("_last")), "mix-buckets")
        if (sums.agg(F.sum("_rows")).first()[0] or 0) <= FEW:
            last = _greedy(open_.collect())
            break
        cum = sums.withColumn("_cum", F.sum("_n").over(Window.partitionBy("_p").orderBy("_b")))
        full = cum.where("_cum <= _rest").groupBy("_p").agg(F.max("_last").alias("_high"), F.max("_cum").alias("_used"))
        edge = cum.where("_cum > _rest and _cum - _n < _rest").select(F.col("_p").alias("_ep"), F.col("_b").alias("_eb"), (F.col("_cum") - F.col("_n")).alias("_before"))
        inside = open_.join(edge, (F.col("_p") == F.col("_ep")) & (bucket == F.col("_eb"))).withColumn("_cum", F.col("_before") + F.sum("_size").over(by_place))
        inside = inside.where("_cum <= _rest").groupBy("_p").agg(F.max(key).alias("_high"), F.max("_cum").alias("_used"))
        ends = full.unionByName(inside).groupBy(F.col("_p").alias("_q")).agg(F.max("_high").alias("_high"), F.max("_used").alias("_used"))
        step = store(state.join(ends, F.col("_p") == F.col("_q")).drop("_q"), "mix-round")
        rounds = step if rounds is None else rounds.unionByName(step)
        state = step.where("_used < _rest").select("_p", (F.col("_rest") - F.col("_used")).alias("_rest"), F.col("_high").alias("_low"))
    out = sized.join(need.select("_p", "_copies"), F.col("_pattern") == F.col("_p"), "left").drop("_p")
    some = F.lit(False)
    if rounds is not None:
        told = rounds.groupBy(F.col("_p").alias("_q")).agg(F.collect_list(F.struct("_rest", "_low", "_high")).alias("_rounds"))
        out = out.join(told, F.col("_pattern") == F.col("_q"), "left").drop("_q")
        within = lambda r: (F.col("_size") <= r["_rest"]) & (key <= r["_high"]) & (r["_low"].isNull() | (key > r["_low"]))
        some = some | ((F.col("_size") > 0) & F.coalesce(F.exists("_rounds", within), F.lit(False)))
    if last:
        ends = F.broadcast(sized.sparkSession.createDataFrame([(u,) for u in last], "_v long"))  # FEW at most
        out = out.join(ends, F.col("_u") == F.col("_v"), "left")
        some = some | F.col("_v").isNotNull()
    out = out.withColumn("_some", some)
    out = out.join(_closing(out, need), F.col("_u") == F.col("_c"), "left")
    return out.withColumn("_taken", F.col("_size") * (F.coalesce("_copies", F.lit(0).cast("long")) + (F.col("_some") | F.col("_c").isNotNull()).cast("long"))).drop("_some", "_c")


def _closing(filled: DataFrame, need: DataFrame) -> DataFrame:
    """``_c``: of each pattern the document, one at most, that brings its
    tokens nearer to what it needs than those that fit do. None fits any more,
    so the smallest that is left overshoots least; it is taken if it does so by
    less than what is missing. Needs are below ``most`` copies of all, so none
    is taken too often."""
    some = F.col("_some")
    told = filled.groupBy("_pattern").agg(F.coalesce(F.sum(F.when(some, F.col("_size"))), F.lit(0)).alias("_used"), F.min(F.when(~some & (F.col("_size") > 0), F.struct("_size", "_h", "_id", "_u"))).alias("_least"))
    near = told.join(need.where("_rest > 0").select("_p", "_rest"), F.col("_pattern") == F.col("_p")).where(F.col("_least._size") < 2 * (F.col("_rest") - F.col("_used")))
    return near.select(F.col("_least._u").alias("_c"))


def mix(docs: DataFrame, weights=(1, 2, 3), most: int = 3, seed: int = 17, id_col: str = "doc_id", sources_col: str = "source", text_col: str = "text") -> DataFrame:
    """``doc_id, sources, size, taken, source_size, target`` per row.

    ``sources_col``: a string, or an array of strings where documents are
    listed by several sources. A source's weight is the next of ``weights``,
    repeated, in code point order, null last. ``source_size`` and ``target``
    are those of the document's first source. All sizes together are shared
    out by weight (see :func:`water_fill`); a document is taken whole, at most
    ``most`` times, so a pattern's words come as near to its share as half of
    its smallest document that isn't taken once more. Null texts have size 0 and are never taken; an empty array
    counts as the null source; repeated rows are documents of their own, in no
    particular order among each other; null ids come first in the order of
    their hash; very long texts are counted whole; other columns are ignored; an empty table gives an empty one.

    A pattern of one source that overlaps with no other carries what its
    source wants, however many such sources there are. Only patterns of
    sources that overlap go to the driver, where their flow is solved; more
    than MAX_PATTERNS of these end with an error.
    """
    spark = docs.sparkSession
    listed = F.col(sources_col) if dict(docs.dtypes)[sources_col].startswith("array") else F.array(sources_col)
    listed = F.array_sort(F.array_distinct(listed))
    listed = F.when(F.coalesce(F.size(listed), F.lit(0)) > 0, listed).otherwise(F.array(F.lit(None).cast("string")))
    words = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    sized = docs.select(F.col(id_col).alias("_id"), listed.alias("_sources"), words.alias("_size"), F.monotonically_increasing_id().alias("_u"))
    sized = store(sized.select("*", F.to_json(F.struct("_sources"), {"ignoreNullFields": "false"}).alias("_pattern"), seeded(seed, F.col("_id")).alias("_h")), "mix-sized")
    patterns = store(sized.groupBy("_pattern").agg(F.first("_sources").alias("_sources"), F.sum("_size").alias("_n")), "mix-patterns")
    total = patterns.agg(F.sum("_n")).first()[0] or 0
    sizes = patterns.select(F.explode("_sources").alias("_s"), "_n").groupBy("_s").agg(F.sum("_n").alias("_source_size"))
    targets = store(water_fill(sizes, total, weights, most), "mix-targets")
    wanted = F.floor(F.coalesce("target", F.lit(0.0)) + 0.5).cast("long")

    shared = patterns.where(F.size("_sources") > 1).select(F.explode("_sources").alias("_o")).distinct()
    overlaps = F.col("_s").eqNullSafe(F.col("_o"))
    touched = patterns.select("_pattern", F.explode("_sources").alias("_s")).join(shared, overlaps, "left_semi").select("_pattern").distinct()
    found = patterns.join(touched, "_pattern", "left_semi").orderBy("_pattern").limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} patterns of overlapping sources")
    alone = patterns.join(touched, "_pattern", "left_anti").select("_pattern", "_n", F.get("_sources", F.lit(0)).alias("_own"))
    alone = alone.join(targets, F.col("_own").eqNullSafe(F.col("_s"))).select("_pattern", "_n", F.least(wanted, F.col("_n") * most).alias("_tokens"))
    if found:
        quotas = {r["_s"]: r["_wanted"] for r in targets.join(shared, overlaps, "left_semi").select("_s", wanted.alias("_wanted")).collect()}
        carried = min_cost_flow({tuple(r["_sources"]): r["_n"] for r in found}, quotas, most).by_pattern()
        alone = alone.unionByName(spark.createDataFrame([(r["_pattern"], r["_n"], carried.get(tuple(r["_sources"]), 0)) for r in found], "_pattern string, _n long, _tokens long"))
    some = F.col("_n") > 0
    need = store(alone.select(F.col("_pattern").alias("_p"), F.when(some, F.expr("_tokens div _n")).otherwise(0).cast("long").alias("_copies"), F.when(some, F.col("_tokens") % F.col("_n")).otherwise(0).cast("long").alias("_rest")), "mix-need")
    first = patterns.select(F.col("_pattern").alias("_f"), F.get("_sources", F.lit(0)).alias("_first")).join(targets, F.col("_first").eqNullSafe(F.col("_s"))).select("_f", F.col("_source_size").alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"))
    out = select_documents(sized, need).join(first, F.col("_pattern") == F.col("_f"))
    return out.select(F.col("_id").alias(id_col), F.col("_sources").alias("sources"), F.col("_size").alias("size"), F.col("_taken").alias("taken"), "source_size", "target")


def oracle(weights=(1, 2, 3), most: int = 3, seed: int = 17) -> str:
    """DuckDB SQL for :func:`mix` over ``documents`` where each document has
    one source: then every pattern's flow is its source's rounded target. The
    tokens on top of whole copies go to one document after the other, what is
    missing then to the smallest other one, if that is nearer."""
    n = len(weights)
    cases = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(weights))
    fits = "z.size > 0 AND z.size <= g.rest"
    return f"""
        WITH RECURSIVE z AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY h, doc_id NULLS FIRST, size, k) AS r FROM (SELECT row_number() OVER () AS k, doc_id, source AS src,
                len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents)),
        s AS (SELECT src, sum(size)::BIGINT AS n, CASE (row_number() OVER (ORDER BY src NULLS LAST) - 1) % {n} {cases} END AS w FROM z GROUP BY src),
        c AS (SELECT *, {most} * n AS cap, sum(n) OVER () AS total, sum(w) OVER () AS all_w, coalesce(sum({most} * n) OVER o, 0) AS cap_before, coalesce(sum(w) OVER o, 0) AS w_before
            FROM s WINDOW o AS (ORDER BY {most} * n / w, src NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        d AS (SELECT *, cap * (all_w - w_before) <= w * (total - cap_before) AS capped FROM c),
        t AS (SELECT src, n, CASE WHEN capped THEN cap::DOUBLE ELSE (w * (total - coalesce(sum(cap) FILTER (capped) OVER (), 0)))::DOUBLE / (all_w - coalesce(sum(w) FILTER (capped) OVER (), 0)) END AS target FROM d),
        need AS (SELECT src, n, target, CASE WHEN n = 0 THEN 0 ELSE floor(target + 0.5)::BIGINT // n END AS copies, CASE WHEN n = 0 THEN 0 ELSE floor(target + 0.5)::BIGINT % n END AS rest FROM t),
        g AS (SELECT src, 0::BIGINT AS r, rest::BIGINT AS rest, 0::BIGINT AS k FROM need
            UNION ALL SELECT g.src, z.r, CASE WHEN {fits} THEN g.rest - z.size ELSE g.rest END, CASE WHEN {fits} THEN z.k ELSE 0 END FROM g JOIN z ON z.src IS NOT DISTINCT FROM g.src AND z.r = g.r + 1),
        left_over AS (SELECT need.src, need.rest - coalesce(sum(z.size) FILTER (z.k IN (SELECT k FROM g)), 0) AS missing FROM need JOIN z ON z.src IS NOT DISTINCT FROM need.src GROUP BY need.src, need.rest),
        closing AS (SELECT z.k FROM z JOIN left_over l ON z.src IS NOT DISTINCT FROM l.src WHERE z.size > 0 AND z.k NOT IN (SELECT k FROM g) QUALIFY row_number() OVER (PARTITION BY z.src ORDER BY z.size, h, doc_id NULLS FIRST, z.k) = 1 AND z.size < 2 * missing)
        SELECT z.doc_id, z.size, need.n AS source_size, need.target, (z.size * (need.copies + CASE WHEN z.k IN (SELECT k FROM g) OR z.k IN (SELECT k FROM closing) THEN 1 ELSE 0 END))::BIGINT AS taken
        FROM z JOIN need ON z.src IS NOT DISTINCT FROM need.src"""
