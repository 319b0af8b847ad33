"""DuckDB SQL of the queries in ``queries``."""

from __future__ import annotations

from hashlib import sha256

from millrace.functions.permutation import PRIME, constants

_WS = r"[\x20\x09-\x0D]+"


def _digits(salt: str, key: str) -> str:
    return f"substr(sha256('{salt}:' || {key}), 1, 8)"


def _hash01(salt: str, key: str) -> str:
    return f"(('0x' || {_digits(salt, key)})::BIGINT::DOUBLE / 4294967295.0::DOUBLE)"


def _tokens(text: str) -> str:
    return f"list_transform(list_filter(string_split_regex({text}, '{_WS}'), lambda w: w <> ''), lambda w: ('0x' || substr(md5(w), 1, 4))::INT % 900 + 10)"


#: Common table expressions by name, each with those that it needs.
_CTE = {
    "docs": ((), "SELECT doc_id, CASE WHEN lang = 'de' THEN 'german' ELSE 'general' END AS domain, lang || '_' || source AS origin, text FROM documents WHERE text IS NOT NULL AND text <> ''"),
    "toks": (("docs",), f"SELECT doc_id, domain, origin, {_tokens('text')} AS tokens FROM docs"),
    "stream": (("toks",), "SELECT domain, origin, tok, row_number() OVER (PARTITION BY domain, origin ORDER BY doc_id, pos) - 1 AS i FROM (SELECT domain, origin, doc_id, unnest(list_append(tokens, 2)) AS tok, unnest(range(len(tokens) + 1)) AS pos FROM toks)"),
    "packed": (("stream",), "SELECT domain, origin, i // 64 AS block, list(tok ORDER BY i) AS token_ids FROM stream GROUP BY ALL"),
    "blocks": (("packed",), """SELECT domain, origin, block, token_ids, CASE WHEN domain = 'german' THEN 0 ELSE 1 END AS origin_tag, CASE WHEN substr(origin, 1, 2) IN ('de', 'en', 'fr') THEN 'cap_' || substr(origin, 1, 2) ELSE origin END AS capability,
        sha256('{"origin":"' || origin || '","token_ids":[' || array_to_string(token_ids, ',') || ']}') AS content_hash FROM packed WHERE len(token_ids) = 64"""),
    "ranked": (("blocks",), f"SELECT *, count(*) OVER (PARTITION BY domain, origin) AS n, row_number() OVER (PARTITION BY domain, origin ORDER BY {_digits('42', 'content_hash')}, content_hash, block) AS r FROM blocks"),
    "sized": (("ranked",), "SELECT *, least(greatest(ceil(n * 0.05::DOUBLE)::BIGINT, least(3, n)), greatest(1, floor(n * 0.2::DOUBLE)::BIGINT)) AS k0 FROM ranked"),
    "split": (("sized",), "SELECT domain, origin, block, token_ids, origin_tag, capability, content_hash, CASE WHEN r <= CASE WHEN k0 >= n THEN greatest(0, n - 1) ELSE k0 END THEN 'holdout' ELSE 'train' END AS split FROM sized"),
    "losses": (("blocks",), "SELECT content_hash, domain || '/' || origin AS o, block, ('0x' || substr(sha256('loss:' || content_hash), 1, 8))::BIGINT % 4000 / 1000.0::DOUBLE AS ref_loss, ('0x' || substr(sha256('cov:' || content_hash), 1, 8))::BIGINT AS c FROM blocks"),
    "cache": (("losses",), "SELECT content_hash, ref_loss, 'f0/' || o AS part, block AS row FROM losses WHERE c % 10 < 9 UNION ALL SELECT content_hash, ref_loss + CASE WHEN c % 20 = 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END, 'f1/' || o, block FROM losses WHERE c % 10 = 0"),
    "dedup": (("cache",), "SELECT content_hash, arg_min(ref_loss, (part, row)) AS ref_loss FROM cache GROUP BY content_hash"),
    "mixed": (("split",), f"""SELECT * EXCLUDE (q, others) FROM (SELECT *, row_number() OVER (PARTITION BY domain = 'german' ORDER BY {_digits('mix:42', 'content_hash')}, content_hash, domain, origin, block) AS q, count(*) FILTER (domain <> 'german') OVER () AS others FROM split)
        WHERE domain = 'german' OR q <= round_even(others * 0.25::DOUBLE, 0)"""),
    "pool": ((), """SELECT *, target_loss - ref_loss AS rho FROM (SELECT event_id AS block_id, event_id // 64 AS step, event_type AS origin, sha256(event_id::VARCHAR) AS content_hash, CASE WHEN user_id % 3 = 0 THEN 0 ELSE 1 END AS origin_tag,
        CASE WHEN event_id % 17 = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS sample_mask, floor(value * 1000)::DOUBLE AS target_loss, (user_id % 50 * 1000)::DOUBLE AS ref_loss FROM events)"""),
    "flagged": (("pool",), "SELECT *, sample_mask > 0 AND row_number() OVER (PARTITION BY step, sample_mask > 0 ORDER BY rho DESC, block_id) <= 16 AS selected FROM pool"),
    "topk": (("pool",), "SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY step ORDER BY rho DESC, block_id))::INT AS sel_rank FROM pool WHERE sample_mask > 0) WHERE sel_rank <= 16"),
    "valid": (("flagged",), "SELECT *, target_loss - rho AS ref FROM flagged WHERE sample_mask > 0"),
    "trace": ((), "SELECT event_id AS i, (event_id // 10) % 40 AS step, sha256(event_id::VARCHAR) AS content_hash FROM events"),
    "by_step": (("pool",), "SELECT step AS batch, sum(sample_mask) AS w, sum(target_loss * sample_mask) / greatest(sum(sample_mask), 1.0) AS v FROM pool GROUP BY step"),
}


def _with(name: str, sql: str) -> str:
    """``sql`` behind the table expressions that ``name`` needs."""
    order: list[str] = []

    def need(n: str) -> None:
        for d in _CTE[n][0]:
            need(d)
        if n not in order:
            order.append(n)

    for n in name.split():
        need(n)
    return "WITH " + ", ".join(f"{n} AS ({_CTE[n][1]})" for n in order) + " " + sql


_KEY = "domain, origin, block"
_CHANCE = "('0x' || substr(sha256('sel:42:' || step::VARCHAR || ':' || block_id::VARCHAR), 1, 8))::BIGINT::DOUBLE"


def _quota(order: str, ratio: float, columns: str = "step, block_id, origin_tag, rho, sel_rank", k: int = 16) -> str:
    return _with("pool", f"""
        , good AS (SELECT * FROM pool WHERE sample_mask > 0),
        n AS (SELECT step, count(*) FILTER (origin_tag = 0) AS na, count(*) FILTER (origin_tag = 1) AS nr, least({k}, count(*)) AS k FROM good GROUP BY step),
        q0 AS (SELECT *, least(round_even(k * {ratio}::DOUBLE, 0)::BIGINT, nr) AS r0 FROM n),
        q AS (SELECT *, least(k - r0, na) AS ka, least(k - least(k - r0, na), nr) AS kr FROM q0),
        r AS (SELECT g.*, row_number() OVER (PARTITION BY step, origin_tag ORDER BY {order}, block_id) AS i FROM good g)
        SELECT {columns} FROM (SELECT r.*, (i + CASE WHEN origin_tag = 1 THEN ka ELSE 0 END)::INT AS sel_rank FROM r JOIN q USING (step) WHERE i <= CASE WHEN origin_tag = 0 THEN ka ELSE kr END)""")


#: Losses of :func:`millrace.plans.queries.fixed` and the made-up references.
_LOSS = "list_sum(list_transform(token_ids[2:], lambda t: t % 7))::DOUBLE / (len(token_ids) - 1)"
_REF = "(token_ids[1] % 5)::DOUBLE"


def _permuted(key: str, n: str = "n", base: str = "m") -> str:
    """``perm(p, y)``: where each p of 0..n-1 goes, by the rounds of a Feistel
    network over a x b and by walking on what falls on n or beyond. ``base`` is
    a table of one row that has n."""
    hashed = lambda v, f, s: f"(({v} + {s}) % {PRIME}) * (({v} + {s}) % {PRIME}) % {PRIME} * {f} % {PRIME}"
    steps = [f"ab AS (SELECT {n} AS n, ceil(sqrt({n}))::BIGINT AS a FROM {base}), abn AS (SELECT n, a, ceil(n / a)::BIGINT AS b FROM ab), s0 AS (SELECT n, a, b, x, x // b AS l, x % b AS r FROM (SELECT *, unnest(range(a * b)) AS x FROM abn))"]
    for i, (f, s) in enumerate(constants(key)):
        half = f"(l + {hashed('r', f, s)}) % a AS l, r" if i % 2 == 0 else f"l, (r + {hashed('l', f, s)}) % b AS r"
        steps.append(f"s{i + 1} AS (SELECT n, a, b, x, {half} FROM s{i})")
    steps.append(f"once AS (SELECT x, l * b + r AS y, n FROM s{len(constants(key))}), walk AS (SELECT x AS p, y FROM once WHERE x < n UNION ALL SELECT p, once.y FROM walk JOIN once ON walk.y = once.x WHERE once.x >= n), perm AS (SELECT p, y FROM walk WHERE y < (SELECT {n} FROM {base}))")
    return "WITH RECURSIVE " + ", ".join(steps)


def _positions(epoch: int, chunk: int = 1) -> str:
    """``number, position`` of an epoch; ``m`` has n."""
    key = f"epoch:42:{epoch}"
    turn = 0 if chunk == 1 else f"{int(sha256(f'{key}:turn'.encode()).hexdigest()[:12], 16)}::BIGINT % n"
    return f"""({_permuted(key, "(n // {0})".format(chunk))} SELECT (p + {turn}) % n AS number, position FROM
        (SELECT y * {chunk} + k AS p, perm.p * {chunk} + k AS position FROM perm, (SELECT unnest(range({chunk})) AS k) UNION ALL SELECT q, q FROM (SELECT unnest(range(n // {chunk} * {chunk}, n)) AS q FROM m)), m)"""


_NUMBERS = f"numbers AS (SELECT *, row_number() OVER (ORDER BY {_digits('order:42', 'content_hash')}, content_hash, origin, block) - 1 AS number FROM blocks), m AS (SELECT count(*) AS n FROM blocks)"


def _loop(sql: str, shuffle: bool = True) -> str:
    """``whole``: the rows of two epochs' whole pools, with their losses."""
    epoch = lambda e: f"SELECT {e} AS epoch, content_hash, origin, token_ids, position AS i, n FROM numbers JOIN {_positions(e) if shuffle else '(SELECT number, number AS position FROM numbers)'} USING (number), m"
    return _with("blocks", f""", {_NUMBERS}, placed AS ({epoch(0)} UNION ALL {epoch(1)}), sizes AS (SELECT *, greatest(16, n // 8) AS size FROM placed),
        whole AS (SELECT *, i // size AS pool, {_LOSS} - {_REF} AS rho FROM sizes WHERE (i // size + 1) * size <= n) {sql}""")


def _phases() -> str:
    """Two traces: the joint ranking, then shares by rank."""
    quota = _quota("-rho", 0.25, "step, sel_rank, content_hash")
    return f"SELECT 0 AS phase, step, sel_rank - 1 AS pos, content_hash FROM ({_with('topk', 'SELECT * FROM topk')}) UNION ALL SELECT 1, step, sel_rank - 1, content_hash FROM ({quota})"


def _family(metric: str) -> str:
    if "_mean_" in metric and metric.endswith(("_selected", "_dropped")):
        return "selection_sanity"
    return {"tar": "loss", "ref": "loss", "rho": "rho"}.get(metric[:3], "rho" if metric.startswith("frac_rho") else "selection")


def _mean(value: str, where: str) -> str:
    return f"coalesce(avg({value}) FILTER ({where}), 'NaN'::DOUBLE)"


def _ratio(n: str, of: str) -> str:
    return f"count(*) FILTER ({n}) / greatest(count(*) FILTER ({of}), 1)::DOUBLE"


#: Places of tokens in a block, and counts of the replay blocks' grams.
_PLACES = f"SELECT {_KEY}, origin_tag, token_ids AS ids, unnest(token_ids) AS token, unnest(range(len(token_ids))) AS pos FROM blocks"
_GRAMS = f"places AS ({_PLACES}), grams AS (SELECT n::INT AS n, ids[pos - n + 1:pos] AS ctx, token, count(*) AS c FROM places, (SELECT unnest(range(3)) AS n) WHERE origin_tag = 1 AND pos >= n GROUP BY ALL)"

_SELECTION = {
    **{f"{c}_{n}": _mean(v, f"origin_tag = {t}") for t, n in ((0, "adapt"), (1, "replay")) for c, v in (("target_loss", "target_loss"), ("ref_loss", "ref"), ("rho_mean", "rho"))},
    **{f"n_selected_{n}": f"count(*) FILTER (selected AND origin_tag = {t})" for t, n in ((0, "adapt"), (1, "replay"))},
    **{f"frac_selected_{n}": _ratio(f"selected AND origin_tag = {t}", f"origin_tag = {t}") for t, n in ((0, "adapt"), (1, "replay"))},
    "frac_rho_replay_above_zero": _ratio("origin_tag = 1 AND rho > 0", "origin_tag = 1"),
    "frac_adapt_in_candidate": _ratio("origin_tag = 0", "true"),
    "k_effective": "count(*) FILTER (selected)",
    **{f"{c}_mean_{n}": _mean(v, w) for n, w in (("selected", "selected"), ("dropped", "NOT selected")) for c, v in (("rho", "rho"), ("target_loss", "target_loss"), ("ref_loss", "ref"))},
}

_SUMS = ", ".join(f"coalesce(sum({v}) FILTER (sample_mask > 0 AND origin_tag = {t}), 0.0)::DOUBLE AS {n}_sum_{c}" for t, c in ((0, "adapt"), (1, "replay")) for n, v in (("target", "target_loss"), ("ref", "ref_loss"), ("rho", "rho")))
_SUMS += ", count(*) FILTER (sample_mask > 0 AND origin_tag = 1 AND rho > 0) AS n_rho_replay_above_zero, count(*) FILTER (sample_mask > 0 AND origin_tag = 0) AS n_adapt, count(*) FILTER (sample_mask > 0 AND origin_tag = 1) AS n_replay"
_MEANS = ", ".join(f"sum({n}_sum_{c}) / greatest(sum(n_{c}), 1)::DOUBLE AS {m}_{c}" for c in ("adapt", "replay") for n, m in (("target", "target_loss"), ("ref", "ref_loss"), ("rho", "rho_mean")))

ORACLE_SQL = {
    "tokenize": _with("toks", "SELECT doc_id, len(tokens)::BIGINT AS n_tokens, array_to_string(tokens, ',') AS tokens FROM toks"),
    "tokenize_bos": _with("toks", "SELECT doc_id, array_to_string(list_prepend(1, tokens), ',') AS tokens FROM toks"),
    "pack_blocks": _with("packed", f"SELECT {_KEY}, array_to_string(token_ids, ',') AS token_ids FROM packed WHERE len(token_ids) = 64"),
    "pack_in_steps": _with("packed", f"SELECT {_KEY}, array_to_string(token_ids, ',') AS token_ids FROM packed WHERE len(token_ids) = 64"),
    "pack_blocks_keep_partial": _with("packed", f"SELECT {_KEY}, len(token_ids)::BIGINT AS n_tokens, array_to_string(token_ids, ',') AS token_ids FROM packed"),
    "content_hashes": _with("blocks", f"SELECT {_KEY}, origin_tag, content_hash FROM blocks"),
    "block_bytes": _with("blocks", f"SELECT {_KEY}, strlen(array_to_string(token_ids, ' '))::BIGINT AS n_bytes FROM blocks"),
    "capability_tag": _with("blocks", "SELECT origin, capability, count(*) AS n_blocks FROM blocks GROUP BY ALL"),
    "doc_sample": _with("docs", f"SELECT doc_id, domain, origin FROM docs WHERE {_hash01('doc:42', 'doc_id::VARCHAR')} < 0.3::DOUBLE"),
    "max_docs_per_origin": _with("docs", "SELECT doc_id, domain, origin FROM docs QUALIFY row_number() OVER (PARTITION BY domain, origin ORDER BY doc_id) <= 3"),
    "holdout_split": _with("split", f"SELECT {_KEY}, content_hash, split FROM split"),
    "balance_replay": _with("split", f"""SELECT {_KEY}, content_hash, split FROM split, (SELECT count(*) FILTER (origin_tag = 0) AS a, count(*) FILTER (origin_tag = 1) AS r FROM blocks)
        WHERE origin_tag = 0 OR r <= a OR {_hash01('pool:42', 'content_hash')} < a / r::DOUBLE"""),
    "cap_per_origin": _with("blocks", f"SELECT {_KEY}, content_hash FROM blocks QUALIFY row_number() OVER (PARTITION BY origin ORDER BY {_digits('val:42', 'content_hash')}, content_hash, block) <= 20"),
    "cap_per_domain": _with("blocks", f""", o AS (SELECT * FROM blocks QUALIFY row_number() OVER (PARTITION BY domain, origin ORDER BY {_digits('cap:42:origin', 'content_hash')}, content_hash, origin, block) <= 30)
        SELECT {_KEY}, content_hash FROM o QUALIFY row_number() OVER (PARTITION BY domain ORDER BY {_digits('cap:42:domain', 'content_hash')}, content_hash, origin, block) <= 400"""),
    "corpus_report": _with("split", "SELECT domain, origin, max(capability) AS capability, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'holdout') AS holdout, count(*) AS total FROM split GROUP BY domain, origin"),
    "clean_origin": """WITH n AS (SELECT DISTINCT ['Nemotron-CC-', 'nemotron-', ' Some ', 'Nemotron-Pretraining-Legal-'][doc_id % 4 + 1] || lang || '--' || source || '_' AS name FROM documents)
        SELECT name, trim(regexp_replace(lower(regexp_replace(trim(name), '^(nemotron-pretraining-legal-|nemotron-pretraining-|nemotron-cc-|nemotron-)', '', 'i')), '[^a-z0-9]+', '_', 'g'), '_') AS origin FROM n""",
    "metric_names": """WITH n AS (SELECT DISTINCT ' ' || p_name || '/x y' AS name, (p_partkey % 4)::INT AS tag FROM part)
        SELECT name, tag, translate(trim(name), ' /', '__') AS key, regexp_replace(trim(name), '[^a-zA-Z0-9_.-]', '_', 'g') AS safe, CASE tag WHEN 0 THEN 'adapt' WHEN 1 THEN 'replay' ELSE 'tag' || tag END AS corpus FROM n""",
    "discover_origins": """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'general' WHEN lang = 'en' AND source = 'src1' THEN 'english_one' ELSE lang || '_' || source END AS origin FROM documents""",
    "pick_spread": """WITH f AS (SELECT p_brand, list_sort(list(DISTINCT p_partkey::VARCHAR)) AS f FROM part GROUP BY p_brand), m AS (SELECT p_brand, f, len(f) AS s, (length(p_brand) + len(f) % 7 - 4)::INT AS n FROM f)
        SELECT p_brand, array_to_string(CASE WHEN n <= 0 THEN []::VARCHAR[] WHEN n >= s THEN f ELSE list_transform(range(n), lambda i: f[least(s - 1, floor(i * (s / n::DOUBLE))::BIGINT) + 1]) END, ',') AS chosen FROM m""",
    "staging_plan": """WITH f AS (SELECT p_brand, list_sort(list(p_brand || '/' || p_partkey || '.parquet') FILTER (p_partkey % 9 <> 0)) AS f FROM part GROUP BY p_brand), m AS (SELECT p_brand, coalesce(f, []::VARCHAR[]) AS f, len(coalesce(f, []::VARCHAR[])) AS s, 2 AS n FROM f)
        SELECT lower(p_brand) AS origin, 'parts' AS capability, s::BIGINT AS n_available, array_to_string(CASE WHEN n >= s THEN f ELSE list_transform(range(n), lambda i: f[least(s - 1, floor(i * (s / n::DOUBLE))::BIGINT) + 1]) END, ',') AS chosen FROM m""",
    "staging_copy": "SELECT 'docs_' || lang AS origin, sha256(text) AS digest, true AS whole, true AS covered FROM documents WHERE text <> ''",
    "ref_cache_dedup": _with("dedup", "SELECT content_hash, ref_loss FROM dedup"),
    "cache_conflicts": _with("cache", "SELECT content_hash, count(DISTINCT ref_loss) AS n_losses, count(*) AS n_rows FROM cache GROUP BY content_hash HAVING count(DISTINCT ref_loss) > 1"),
    "join_ref_loss": _with("split dedup", f"SELECT {_KEY}, content_hash, ref_loss FROM split JOIN dedup USING (content_hash)"),
    "join_ref_loss_bucketed": _with("split", f"SELECT {_KEY}, content_hash, split, ({_LOSS})::FLOAT::DOUBLE AS ref_loss FROM split"),
    "missing_ref_loss": _with("split dedup", f"SELECT {_KEY}, content_hash FROM split ANTI JOIN dedup USING (content_hash)"),
    "mix_train": _with("split dedup", f"SELECT {_KEY}, ref_loss, capability FROM split JOIN dedup USING (content_hash) WHERE split = 'train'"),
    "mix_val": _with("split", f"SELECT {_KEY}, content_hash FROM split WHERE split = 'holdout' QUALIFY row_number() OVER (PARTITION BY origin ORDER BY {_digits('val:42', 'content_hash')}, content_hash, block) <= 2"),
    "mix_fixed_replay": _with("mixed", f"SELECT {_KEY}, content_hash FROM mixed WHERE split = 'train'"),
    "precompute_slice": _with("split", f"SELECT {_KEY}, split FROM split WHERE domain = 'german'"),
    "read_cap_fallback": _with("split", f"SELECT {_KEY}, content_hash FROM split WHERE split = 'train' ORDER BY origin, block LIMIT 64"),
    "pool_batches": _with("blocks", f""", p AS (SELECT *, row_number() OVER (ORDER BY {_digits('epoch:42:0', 'content_hash')}, content_hash, origin, block) - 1 AS block_id, count(*) OVER () AS n FROM blocks)
        SELECT {_KEY}, block_id // 32 AS step, block_id FROM p WHERE (block_id // 32 + 1) * 32 <= n"""),
    "token_histogram": _with("blocks", "SELECT unnest(token_ids) AS token, count(*) AS n FROM blocks GROUP BY 1"),
    "target_loss": _with("blocks", f""", m AS (SELECT {_KEY}, block % 5 <> 0 AS live, list_filter(token_ids[2:], lambda t: t % 3 <> 0) AS t FROM blocks)
        SELECT {_KEY}, CASE WHEN live THEN coalesce(list_sum(list_transform(t, lambda x: x % 7)), 0)::DOUBLE / greatest(len(t), 1)::DOUBLE ELSE 0.0::DOUBLE END AS target_loss, CASE WHEN live THEN len(t) ELSE 0 END::DOUBLE AS n_response_tokens FROM m"""),
    "assistant_mask": f"""WITH t AS (SELECT conv_id, turn, coalesce(role = 'assistant', false) AS own, {_tokens('text')} AS t FROM (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations)),
        c AS (SELECT conv_id, flatten(list(t ORDER BY turn)) AS ids, string_agg(repeat(CASE WHEN own THEN '1' ELSE '0' END, len(t)), '' ORDER BY turn) AS mask FROM t GROUP BY conv_id)
        SELECT conv_id, len(ids)::BIGINT AS n_tokens, len(replace(mask, '0', ''))::BIGINT AS n_response_tokens, array_to_string(ids, ',') AS token_ids, mask FROM c""",
    "rho": _with("pool", "SELECT step, block_id, rho, ref_loss FROM pool"),
    "score_metrics": _with("pool", "SELECT step, sum(target_loss * sample_mask) / greatest(sum(sample_mask), 1.0::DOUBLE) AS candidate_loss, sum(sample_mask) AS num_valid_candidates FROM pool GROUP BY step"),
    "select_top_k": _with("topk", "SELECT step, block_id, origin_tag, rho, sel_rank FROM topk"),
    "select_fixed_ratio": _quota(_CHANCE, 0.25),
    "select_replay_only_rho": _quota(f"CASE WHEN origin_tag = 1 THEN -rho ELSE {_CHANCE} END", 0.25),
    "select_fixed_ratio_rho": _quota("-rho", 0.25),
    "select_backfill": _quota("-rho", 0.95, "step, block_id, origin_tag, sel_rank", 48),
    "gather_selected": _with("topk", "SELECT step, sel_rank - 1 AS pos, block_id, content_hash, target_loss, ref_loss FROM topk"),
    "collate_samples": _with("blocks", """SELECT block AS idx, len(token_ids)::INT AS length, CASE WHEN block % 4 = 0 THEN 'unknown' ELSE origin END AS origin, CASE WHEN block % 3 = 0 THEN 0 ELSE origin_tag END AS origin_tag,
        CASE WHEN block % 7 = 0 THEN '' ELSE content_hash END AS content_hash, 1.0::DOUBLE AS loss_multiplier, CASE WHEN block % 2 = 0 THEN (token_ids[1] % 5)::DOUBLE END AS ref_loss, len(token_ids)::DOUBLE AS n_trained FROM blocks"""),
    "collate_batches": _with("pool", "SELECT step, block_id, CASE WHEN block_id % 3 = 0 THEN 'unknown' ELSE origin END AS origin, origin_tag, content_hash, CASE WHEN step % 2 = 0 THEN ref_loss END AS ref_loss FROM pool"),
    "selection_metrics": _with("valid", "SELECT step, " + ", ".join(f"{v} AS {k}" for k, v in _SELECTION.items()) + " FROM valid GROUP BY step"),
    "metrics_long": _with("valid", ", m AS (SELECT step, " + ", ".join(f"({v})::DOUBLE AS \"{_family(k)}/{k}\"" for k, v in _SELECTION.items()) + " FROM valid GROUP BY step) SELECT step, 'train' AS prefix, metric, value FROM (UNPIVOT m ON COLUMNS(* EXCLUDE step) INTO NAME metric VALUE value)"),
    "metric_log": _with("by_step", ", m AS (SELECT batch AS step, v AS candidate_loss, w::DOUBLE AS num_valid_candidates FROM by_step) SELECT step, CASE WHEN step % 2 = 0 THEN 'train' ELSE 'score' END AS prefix, metric, value FROM (UNPIVOT m ON COLUMNS(* EXCLUDE step) INTO NAME metric VALUE value)"),
    "rho_percentiles": _with("pool", "SELECT step, CASE origin_tag WHEN 0 THEN 'adapt' ELSE 'replay' END AS corpus, " + ", ".join(f"round(quantile_cont(rho, {q}), 3) AS {n}" for q, n in ((0.1, "p10"), (0.5, "p50"), (0.9, "p90"), (0.99, "p99"))) + " FROM pool WHERE sample_mask > 0 AND step % 5 = 0 GROUP BY step, origin_tag"),
    "selection_by_origin": _with("valid", "SELECT step, CASE origin_tag WHEN 0 THEN 'adapt' ELSE 'replay' END AS corpus, origin, count(*) AS n_candidate, count(*) FILTER (selected) AS n_selected, count(*) FILTER (selected) / count(*)::DOUBLE AS frac_selected, avg(rho) AS rho_mean, avg(CASE WHEN rho > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS frac_above_zero FROM valid GROUP BY step, origin_tag, origin"),
    "reduce_train_metrics": "WITH e AS (SELECT event_id // 64 AS step, CASE WHEN event_type = 'click' THEN 'lr' ELSE event_type END AS metric, floor(value)::DOUBLE AS value FROM events) SELECT step, metric, CASE WHEN metric = 'lr' THEN avg(value) ELSE sum(value) END AS value FROM e GROUP BY step, metric",
    "merge_microbatch_metrics": "WITH e AS (SELECT event_id // 64 AS batch, CASE WHEN event_type = 'click' THEN 'global_valid_seqs' ELSE event_type END AS metric, floor(value)::DOUBLE AS value FROM events) SELECT batch, metric, CASE WHEN metric = 'global_valid_seqs' THEN avg(value) ELSE sum(value) END AS value FROM e GROUP BY batch, metric",
    "val_loss_weighted": _with("by_step", "SELECT 'all' AS batches, round(sum(v * w) / sum(w), 4) AS val_loss, count(*) AS n_batches FROM by_step UNION ALL SELECT 'first', round(sum(v * w) / sum(w), 4), count(*) FROM by_step WHERE batch < 10"),
    "validation_pass": _with("split", f""", v AS (SELECT origin, origin_tag, {_LOSS} AS t, {_REF} AS r FROM split WHERE split = 'holdout'),
        c AS (SELECT CASE origin_tag WHEN 0 THEN 'adapt' ELSE 'replay' END AS c, sum(t) AS t, sum(r) AS r, sum(t - r) AS d, count(*) AS n FROM v GROUP BY origin_tag),
        every AS (SELECT a.c, coalesce(t, 0) AS t, coalesce(r, 0) AS r, coalesce(d, 0) AS d, coalesce(n, 0) AS n FROM (VALUES ('adapt'), ('replay')) a(c) LEFT JOIN c USING (c)),
        o AS (SELECT origin, avg(t) AS t, avg(r) AS r, count(*)::DOUBLE AS n FROM v GROUP BY origin),
        m AS (SELECT 'val_loss' AS metric, avg(t) AS value FROM v
            UNION ALL SELECT k || c, s / greatest(n, 1) FROM (SELECT c, n, unnest(['target_loss_', 'ref_loss_', 'rho_mean_']) AS k, unnest([t, r, d]) AS s FROM every)
            UNION ALL SELECT 'frac_rho_replay_above_zero', count(*) FILTER (origin_tag = 1 AND t > r) / greatest(count(*) FILTER (origin_tag = 1), 1)::DOUBLE FROM v
            UNION ALL SELECT 'loss_by_origin_' || origin || k, x FROM (SELECT origin, unnest(['/target_loss', '/ref_loss', '/n']) AS k, unnest([t, r, n]) AS x FROM o))
        SELECT metric, round(value, 6) AS value FROM m"""),
    "val_shuffle": _with("split", f"SELECT {_KEY}, (row_number() OVER (ORDER BY {_digits('valshuf:42', 'content_hash')}, content_hash, origin, block) - 1) // 32 AS batch, row_number() OVER (ORDER BY {_digits('valshuf:42', 'content_hash')}, content_hash, origin, block) - 1 AS pos FROM split WHERE split = 'holdout'"),
    "corpus_sums": _with("pool", f"SELECT step AS batch, {_SUMS} FROM pool GROUP BY step"),
    "corpus_means": _with("pool", f", s AS (SELECT step, {_SUMS} FROM pool GROUP BY step) SELECT {_MEANS}, sum(n_rho_replay_above_zero) / greatest(sum(n_replay), 1)::DOUBLE AS frac_rho_replay_above_zero FROM s"),
    "val_loss_by_origin": _with("pool", "SELECT origin, avg(target_loss) AS target_loss, avg(ref_loss) AS ref_loss, count(*) AS n FROM pool WHERE sample_mask > 0 GROUP BY origin"),
    "trace_period": _with("topk", "SELECT step, content_hash, origin, origin_tag, rho, target_loss, sel_rank AS rank FROM topk WHERE step % 3 = 0"),
    "trace_last_batch": _with("trace", "SELECT step, (row_number() OVER (PARTITION BY step ORDER BY i) - 1)::INT AS pos, content_hash FROM (SELECT * FROM trace QUALIFY row_number() OVER (PARTITION BY step ORDER BY i DESC) <= 10)"),
    "trace_restart": _with("trace", ", b AS (SELECT *, CASE WHEN lag(step) OVER (ORDER BY i) IS DISTINCT FROM step THEN i END AS begin_i FROM trace), l AS (SELECT *, max(begin_i) OVER (PARTITION BY step) AS last_i FROM b) SELECT step, (row_number() OVER (PARTITION BY step ORDER BY i) - 1)::INT AS pos, content_hash FROM l WHERE i >= last_i"),
    "trace_round_trip": _phases(),
    "build_curriculum": _with("blocks", f""", p AS (SELECT content_hash, row_number() OVER (ORDER BY {_digits('cur', 'content_hash')}, content_hash, origin, block) - 1 AS i, count(*) OVER () AS n FROM blocks),
        one AS (SELECT content_hash, arg_max((domain, origin, block), (domain, origin, block)) AS b FROM blocks GROUP BY content_hash)
        SELECT i // 8 AS step, i % 8 AS pos, content_hash, b[1] AS domain, b[2] AS origin, b[3] AS block FROM p JOIN one USING (content_hash) WHERE (i // 8 + 1) * 8 <= n"""),
    "curriculum_order": _with("blocks", f""", p AS (SELECT content_hash, row_number() OVER (ORDER BY {_digits('cur', 'content_hash')}, content_hash, origin, block) - 1 AS i, count(*) OVER () // 8 * 8 AS n FROM blocks)
        SELECT i // 16 AS step, i AS block_id, content_hash FROM p WHERE (i // 16 + 1) * 16 <= n"""),
    "merge_weights": """WITH b AS (SELECT vec_id, embedding, vec_id % 7 <> 0 AND vec_id % 5 <> 0 AND vec_id % 3 <> 0 AS merged FROM embeddings),
        m AS (SELECT vec_id, merged, CASE WHEN merged THEN list_transform(embedding, lambda x: (x * 0.75::FLOAT)::FLOAT + ((x * 3::FLOAT)::FLOAT * 0.25::FLOAT)::FLOAT) ELSE embedding END AS v FROM b)
        SELECT vec_id::VARCHAR AS name, merged, md5(array_to_string(list_transform(v, lambda x: floor(x::DOUBLE * 1000)::BIGINT::VARCHAR), ',')) AS digest, len(v)::BIGINT AS n FROM m""",
    "tensors_round_trip": "SELECT vec_id::VARCHAR AS name, 'float32' AS dtype, len(embedding)::INT AS length, md5(array_to_string(list_transform(embedding, lambda x: floor(x::DOUBLE * 1000)::BIGINT::VARCHAR), ',')) AS digest FROM embeddings",
    "loop_resume": _loop(f""", r AS (SELECT *, row_number() OVER (PARTITION BY epoch, pool ORDER BY rho DESC, i) AS rank FROM whole)
        SELECT epoch * (n // size) + pool + 1 AS step, content_hash, origin, rho, rank::INT AS rank FROM r WHERE rank <= 16"""),
    "loop_plain": _loop("SELECT pool + 1 AS step, content_hash, i AS block_id FROM whole WHERE epoch = 0"),
    "run_snapshot": _loop(""", r AS (SELECT *, row_number() OVER (PARTITION BY epoch, pool ORDER BY rho DESC, i) AS rank FROM whole)
        SELECT pool + 1 AS step, 16::BIGINT AS k, content_hash, rank::INT AS rank FROM r WHERE rank <= 16 AND epoch = 0 AND pool < 4"""),
    "epoch_order": _with("blocks", f", {_NUMBERS} " + " UNION ALL ".join(f"SELECT {_KEY}, {e}::INT AS epoch, position FROM numbers JOIN {_positions(e, c)} USING (number)" for e, c in ((0, 1), (1, 1), (2, 5)))),
    "ngram_counts": _with("blocks", f", {_GRAMS} SELECT n, token, count(*) AS contexts, sum(c)::BIGINT AS c FROM grams GROUP BY ALL"),
    "ngram_losses": _with("blocks", f""", {_GRAMS}, contexts AS (SELECT n, ctx, sum(c) AS c FROM grams GROUP BY ALL), every AS ({_PLACES}),
        p0 AS (SELECT e.*, (coalesce(g.c, 0) + 4.0::DOUBLE * (1.0::DOUBLE / 131072)) / (x.c + 4.0::DOUBLE) AS p FROM every e JOIN contexts x ON x.n = 0 LEFT JOIN grams g ON g.n = 0 AND g.token = e.token),
        p1 AS (SELECT e.* EXCLUDE p, CASE WHEN pos >= 1 THEN (coalesce(g.c, 0) + 4.0::DOUBLE * p) / (coalesce(x.c, 0) + 4.0::DOUBLE) ELSE p END AS p FROM p0 e LEFT JOIN grams g ON g.n = 1 AND g.ctx = ids[pos:pos] AND g.token = e.token LEFT JOIN contexts x ON x.n = 1 AND x.ctx = ids[pos:pos]),
        p2 AS (SELECT e.* EXCLUDE p, CASE WHEN pos >= 2 THEN (coalesce(g.c, 0) + 4.0::DOUBLE * p) / (coalesce(x.c, 0) + 4.0::DOUBLE) ELSE p END AS p FROM p1 e LEFT JOIN grams g ON g.n = 2 AND g.ctx = ids[pos - 1:pos] AND g.token = e.token LEFT JOIN contexts x ON x.n = 2 AND x.ctx = ids[pos - 1:pos])
        SELECT {_KEY}, sum(round(ln(p) * -1000000)::BIGINT)::BIGINT AS loss, count(*) AS n_tokens FROM p2 GROUP BY ALL"""),
    "loop_counters": _loop(", s AS (SELECT count(DISTINCT pool) FILTER (pool % 3 <> 1) AS t, any_value(size) AS size FROM whole WHERE epoch = 0) SELECT 1::BIGINT AS epoch, 0::BIGINT AS step, t AS total_steps, (t * size)::BIGINT AS consumed_samples, (t * 16 * 64)::BIGINT AS total_valid_tokens FROM s", shuffle=False),
    "cache_passes": _with("blocks", f"SELECT DISTINCT content_hash, ({_LOSS})::FLOAT::DOUBLE AS ref_loss FROM blocks"),
    "cache_pass_cap": _with("blocks", ", d AS (SELECT content_hash, origin, origin_tag, min(block) AS block FROM blocks WHERE domain = 'german' GROUP BY ALL) SELECT content_hash, origin, origin_tag, 63 AS n_response_tokens FROM d ORDER BY origin, block LIMIT 100"),
    "read_documents": "SELECT 'folder_nemotron_cc_' || lang AS origin, sha256(text) AS digest, length(text)::INT AS n_chars FROM documents WHERE text <> ''",
    "read_documents_glob": "SELECT 'train_1' AS origin, sha256(text) AS digest FROM documents WHERE text <> '' AND doc_id % 2 = 0 AND lang IN ('de', 'en', 'es')",
    "read_blocks_cap": _with("blocks", ", s AS (SELECT domain FROM blocks) SELECT least(300, count(*)) AS n_rows, 1::BIGINT AS n_domains FROM s"),
    "cap_gate": _with("blocks", "SELECT origin, 2 * count(*) AS n FROM blocks GROUP BY origin"),
    "map_round_trip": "SELECT DISTINCT lang || '_' || source AS origin, 'cap_' || lang AS capability FROM documents WHERE lang IN ('de', 'en', 'fr')",
    "streaming_loop": _with("topk", "SELECT step, content_hash, origin, origin_tag, rho, target_loss, sel_rank AS rank FROM topk"),
    "streaming_scattered": _with("topk", "SELECT step, content_hash, origin, origin_tag, rho, target_loss, sel_rank AS rank FROM topk"),
    "stream_consumed": _with("topk", "SELECT step, row_number() OVER (ORDER BY step) * 64 AS consumed_samples FROM (SELECT DISTINCT step FROM topk)"),
    "jsonl_round_trip": _with("blocks", "SELECT origin, origin_tag, capability, count(*) AS n, count(DISTINCT content_hash) AS n_hashes FROM blocks GROUP BY ALL"),
    "blocks_round_trip": _with("split", f"SELECT {_KEY}, content_hash, split FROM split"),
}
