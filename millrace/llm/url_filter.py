"""URL filter: allow and block rules, else logistic regression on hashed
character n-grams of host and path, trained from a small labelled URL table."""

from __future__ import annotations

import re
from dataclasses import dataclass
from pathlib import Path
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.shared import store

#: Most labelled rows that training takes; a larger table is refused.
MAX_LABELLED = 10_000

#: The default labelled table: label and URL by line.
LABELS = Path(__file__).with_name("url_labels.tsv")

_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_UPPER = str.maketrans(_CAPITALS, _CAPITALS.lower())
_DIGIT = re.compile("[0-9]")
_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.S)


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def split_url(url: str | None) -> tuple[str, str]:
    """Lower-cased host and path; both empty without ``://``. The host goes
    from the first ``://`` to ``/``, ``?``, ``#`` or the end."""
    found = _URL.search(url) if url else None
    return (found[1].translate(_UPPER), found[2]) if found else ("", "")


def read_labels(path: str | Path = LABELS) -> list[tuple[str, int]]:
    """Labelled URLs of a table of lines ``block`` or ``allow``, tab, URL; 1 is block."""
    rows = [line.split("\t", 1) for line in Path(path).read_text(encoding="utf-8").splitlines() if line.strip()]
    odd = [r[0] for r in rows if len(r) != 2 or r[0] not in ("block", "allow")]
    if odd:
        raise ValueError(f"{path}: neither block nor allow: {odd[:3]}")
    return [(url, int(label == "block")) for label, url in rows]


def spread(labelled: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """More rows from each labelled URL, by rule: its host under the same
    prefixes and paths whatever its label, so that these tell nothing, and the
    words of its host, where the other label has none of them, as hosts of
    their own."""
    out, words = list(labelled), {0: set(), 1: set()}
    for url, label in labelled:
        host = re.sub(r"^(www|blog|m)\.", "", split_url(url)[0])
        out += [(f"http://{front}{host}{tail}", label) for front, tail in (("", "/en/1"), ("www.", "/de/2.html"), ("blog.", "/fr/3/"), ("m.", "/es/4"), ("", ""))]
        words[label] |= set(re.findall("[a-z]{3,}", re.sub(r"(\.example)?\.(com|net|org)$", "", host)))
    shapes = ("www.{}-online.example.com/en/1", "{}.example.net/de/2.html", "blog.my-{}.example.org/fr/3/", "m.{}24.example.com/es/4")
    for label in (0, 1):
        for i, word in enumerate(sorted(words[label] - words[1 - label])):
            out += [(f"http://{shapes[i % len(shapes)].format(word)}", label), (f"http://{word}", label)]
    return out


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float

    def block(self, host: str, path: str) -> bool:
        where, values = features(host, path, len(self.weights))
        return bool(self.bias + (values * self.weights[where]).sum() > 0)


def features(host: str, path: str, buckets: int, sizes: tuple[int, ...] = (3, 4, 5)) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of ``^host$`` and ``^path$``, which have hashes
    of their own, and their values. Digits count alike. Host and path are each
    scaled to a length, so that a long path doesn't drown the host, which
    tells most."""
    where, values = [], []
    for kind, text, weight in (("h", host, 1.0), ("p", path, 0.3)):
        part = _DIGIT.sub("0", f"^{text}$") if text else ""
        own = [crc32(f"{kind}{part[i : i + n]}".encode("utf-8", "surrogatepass")) % buckets for n in sizes for i in range(len(part) - n + 1)]
        where += own
        values += [weight / max(len(own), 1) ** 0.5] * len(own)
    return np.array(where, dtype=np.int64), np.array(values)


def train(labelled: list[tuple[str | None, int]], buckets: int = 1 << 14, rounds: int = 3000, rate: float = 4.0, ridge: float = 1e-5, prior: float = 0.3) -> Model:
    """Full-batch gradient descent from zero: the same table gives the same
    model. The bias isn't fitted but stands for the share of URLs that are to
    be blocked, so that a URL without any evidence is allowed. An empty table
    gives the model that allows all."""
    if len(labelled) > MAX_LABELLED:
        raise ValueError(f"more than {MAX_LABELLED} labelled URLs")
    weights, bias = np.zeros(buckets), float(np.log(prior / (1 - prior)))
    if not labelled:
        return Model(weights, bias)
    rows = [features(*split_url(u), buckets) for u, _ in labelled]
    row = np.repeat(np.arange(len(rows)), [len(w) for w, _ in rows])
    col, val = np.concatenate([w for w, _ in rows]), np.concatenate([v for _, v in rows])
    goal = np.array([y for _, y in labelled], dtype=float)
    # both classes weigh the same, however many rows they have
    even = np.where(goal == 1, 0.5 / max(goal.sum(), 1), 0.5 / max((1 - goal).sum(), 1))
    for _ in range(rounds):
        z = bias + np.bincount(row, val * weights[col], len(rows))
        off = (1 / (1 + np.exp(-z)) - goal) * even
        weights -= rate * (np.bincount(col, val * off[row], buckets) + ridge * weights)
    return Model(weights, bias)


def rule_table(spark: SparkSession, rules: list[Rule] | DataFrame) -> DataFrame:
    """``r_host, r_path, r_action, r_text`` of rules (action, host, path), each
    host and path once; of two that are equal block wins."""
    rows = rules if isinstance(rules, DataFrame) else spark.createDataFrame([(r.action, r.host, r.path) for r in rules], "action string, host string, path string")
    rows = rows.select(F.translate("host", _CAPITALS, _CAPITALS.lower()).alias("r_host"), F.col("path").alias("r_path"), "action", F.concat("host", "path").alias("text"))
    told = rows.groupBy("r_host", "r_path").agg(F.max(F.struct((F.col("action") == "block").alias("b"), F.col("action"), F.col("text"))).alias("_r"))
    return told.select("r_host", "r_path", F.col("_r.action").alias("r_action"), F.col("_r.text").alias("r_text"))


def with_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (_u, host, path) with ``rule`` and ``action`` of the longest
    rule that fits, null where none does; of two as long, that with the longer
    host.

    A host asks for itself and each of its parents, as many labels as any rule
    has, for which lengths of paths rules are there, and then for its path's
    beginnings of these lengths: joins by equality, however many rules there
    are. A host with many URLs is skewed on the URLs' side, which is split."""
    rules = store(rules, "rules")
    most = rules.agg(F.max(F.size(F.split("r_host", r"\."))).alias("n")).first()["n"] or 0
    lengths = rules.select(F.col("r_host").alias("l_host"), F.length("r_path").alias("n")).distinct()
    labels = F.split("host", r"\.", -1)
    parents = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(most, 1)))), lambda k: F.array_join(F.slice(labels, F.size(labels) - k + 1, k), "."))
    asked = urls.where("host <> ''").select("_u", "path", F.explode(parents).alias("of")).where("of <> ''")
    asked = asked.join(lengths, F.col("of") == F.col("l_host")).where(F.length("path") >= F.col("n")).select("_u", "of", F.expr("substring(path, 1, n)").alias("start"))
    found = asked.join(rules, (F.col("of") == F.col("r_host")) & (F.col("start") == F.col("r_path")))
    best = found.groupBy(F.col("_u").alias("_v")).agg(F.max(F.struct(F.length("r_text").alias("n"), F.length("r_host").alias("h"), F.col("r_text"), F.col("r_action"))).alias("_r"))
    return urls.join(best, F.col("_u") == F.col("_v"), "left").select("_u", "host", "path", F.col("_r.r_text").alias("rule"), F.col("_r.r_action").alias("action"))


def filter_urls(pages: DataFrame, rules: list[Rule] | DataFrame, labelled: list[tuple[str | None, int]] | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, by_rule`` per row of ``pages``.

    The longest rule that fits decides; where none fits, the model's block or
    allow. Rules are a table (action, host, path) of any size, or a list. Null
    or relative URLs have empty host and path, no rule, and the verdict of the
    model's bias. Repeated rows each give a row, null ids stay null, other
    columns are ignored, very long URLs are judged whole, an empty table gives
    an empty one. Equal host and path in two rules: block wins.
    """
    model = train(spread(read_labels()) if labelled is None else labelled)
    text = F.coalesce(url_col, F.lit(""))
    part = lambda k: F.regexp_extract(text, r"(?s)://([^/?#]*)([^?#]*)", k)
    urls = store(pages.select(F.col(id_col).alias("_id"), F.translate(part(1), _CAPITALS, _CAPITALS.lower()).alias("host"), part(2).alias("path"), F.monotonically_increasing_id().alias("_u")), "urls")

    @F.pandas_udf("boolean")
    def blocked(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([model.block(h, p) for h, p in zip(hosts, paths)], index=hosts.index, dtype=bool)

    told = with_rules(urls.select("_u", "host", "path"), rule_table(pages.sparkSession, rules))
    told = told.join(urls.select(F.col("_u").alias("_w"), "_id"), F.col("_u") == F.col("_w"))
    told = store(told.select("_id", "host", "path", "rule", "action"), "ruled-urls")
    own = told.where("action is not null").select("_id", "host", "path", "rule", F.col("action").alias("verdict"), F.lit(True).alias("by_rule"))
    rest = told.where("action is null").select("_id", "host", "path", "rule", F.when(blocked("host", "path"), "block").otherwise("allow").alias("verdict"), F.lit(False).alias("by_rule"))
    return own.unionByName(rest).withColumnRenamed("_id", id_col)
