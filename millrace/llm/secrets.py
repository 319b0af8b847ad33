"""Secret scans with DataFrame functions alone, and multipart linking.

Assignments, access ids and long hex strings are reported by themselves. Weak
candidates (bare key-like strings, account names, endpoints) are only reported
when complementary parts of a credential stand within one scope: an interval
join of identifiers, secrets and endpoints by position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import store
from millrace.llm.spans import gaps, joined, named, spans

#: Code points that the starts of two linked parts may be apart.
SCOPE = 400

ASSIGN = r"""(?=[pPsStTaA])(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"[0-9a-f]{32,}+"
#: Weak parts.
KEY_LIKE = r"(?<![A-Za-z0-9/+=_.-])(?=[A-Za-z/+]*+[0-9])(?=[0-9/+]*+[A-Za-z])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=_-])"
ACCOUNT = r"""(?=[aAcCuUlL])(?i:access_?key_?id|client_?id|username|user_?id|login|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{4,}+"""
ENDPOINT = r"(?=[a-z])(?:https?|ftp|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[A-Za-z0-9._:@-]++"

#: Kind, pattern, role in a credential, whether it stands by itself.
PARTS = (("assign", ASSIGN, "secret", True), ("access", ACCESS, "identifier", True), ("hex", HEX, "secret", True), ("key_like", KEY_LIKE, "secret", False), ("account", ACCOUNT, "identifier", False), ("endpoint", ENDPOINT, "endpoint", False))
#: Roles that must stand in scope for a weak part of a role to be reported.
NEEDS = {"secret": ("identifier",), "identifier": ("secret",), "endpoint": ("identifier", "secret")}


def parts(docs: DataFrame) -> DataFrame:
    """``doc_id, _t`` (text hash) and an array of spans per kind."""
    text = F.col("_text")
    out = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    out = out.select("doc_id", "_text", F.xxhash64("_text").alias("_t"), *(gaps(text, p).alias(f"_g_{k}") for k, p, _, _ in PARTS))
    out = out.select("doc_id", "_t", *(F.when(F.col(f"_g_{k}").isNotNull(), spans(text, p, F.col(f"_g_{k}"))).alias(f"_f_{k}") for k, p, _, _ in PARTS))
    keep = {"assign": lambda x: F.length(F.regexp_extract(x["v"], ASSIGN, 1)) >= 8}
    none = F.array().cast("array<struct<k:int,s:int,e:int,t:string>>")
    return out.select("doc_id", "_t", *(F.coalesce(named(F.col(f"_f_{k}"), k, i, keep.get(k)), none).alias(k) for i, (k, _, _, _) in enumerate(PARTS)))


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``_d, _dt, _weak``: the weak spans whose complementary parts are in scope.

    Positions are dealt into bins as wide as the scope. Per document, role and
    bin only the first and last start count, as whether one is near enough
    depends on these alone; each weak part then meets three bins of a role at
    most, however many parts a document has.
    """
    roles = F.create_map(*(x for i, (_, _, role, _) in enumerate(PARTS) for x in (F.lit(i), F.lit(role))))
    every = found.select("doc_id", "_t", F.explode(F.concat(*(k for k, _, _, _ in PARTS))).alias("_x")).withColumn("_role", roles[F.col("_x.k")])
    bins = every.groupBy(F.col("doc_id").alias("_bd"), F.col("_t").alias("_bt"), F.col("_role").alias("_brole"), F.floor(F.col("_x.s") / scope).alias("_bin")).agg(F.min("_x.s").alias("_low"), F.max("_x.s").alias("_high"))
    weak = [i for i, (_, _, _, alone) in enumerate(PARTS) if not alone]
    near = F.floor(F.col("_x.s") / scope)
    asks = every.where(F.col("_x.k").isin(weak)).distinct().select("*", F.explode(F.array(near - 1, near, near + 1)).alias("_at"))
    met = asks.join(bins, F.col("doc_id").eqNullSafe(F.col("_bd")) & (F.col("_t") == F.col("_bt")) & (F.col("_at") == F.col("_bin")) & (F.col("_low") <= F.col("_x.s") + scope) & (F.col("_high") >= F.col("_x.s") - scope))
    met = met.groupBy("doc_id", "_t", "_x", "_role").agg(F.collect_set("_brole").alias("_near"))
    whole = F.lit(False)
    for role, needs in NEEDS.items():
        has = F.col("_role") == role
        for n in needs:
            has = has & F.array_contains("_near", n)
        whole = whole | has
    return met.where(whole).groupBy(F.col("doc_id").alias("_d"), F.col("_t").alias("_dt")).agg(F.collect_list("_x").alias("_weak"))


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``doc_id``, arrays of spans by base kind, ``_base`` and ``_all``.

    Texts are read whole, once; only spans are shuffled. A null text is empty;
    null ids stay null; repeated rows each give a row with the same spans;
    other columns are ignored; an empty table gives an empty one.
    """
    found = store(parts(docs), "secret-parts")
    out = found.join(linked(found, scope), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_t") == F.col("_dt")), "left")
    base = F.concat("assign", "access", "hex")
    weak = F.coalesce("_weak", F.array().cast("array<struct<k:int,s:int,e:int,t:string>>"))
    return out.select("doc_id", "assign", "access", "hex", joined(base, True).alias("_base"), joined(F.concat(base, weak), True).alias("_all"))
