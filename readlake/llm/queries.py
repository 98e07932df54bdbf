"""Queries of the training-data operators, by the names the entry module registers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op1_quality, op2_token_files, op3_url_rules, op4_mix, op5_brown, op6_ann, op7_reshard, op8_pack, op9_simhash, op10_repeats


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality.query,
        "op2_token_files": op2_token_files.query,
        "op3_url_rules": op3_url_rules.query,
        "op4_mix": op4_mix.query,
        "op5_brown_lm": op5_brown.query,
        "op6_ann_tree": op6_ann.query,
        "op7_reshard": op7_reshard.query,
        "op8_pack": op8_pack.query,
        "op9_simhash": op9_simhash.query,
        "op10_repeats": op10_repeats.query,
    }


def oracle_sql() -> dict[str, str]:
    """In SQL where SQL can express it; hashes, tokenizers, trees and suffix arrays can't, and are tested against brute force."""
    return {"op1_quality_rules": _quality_sql(), "op3_url_rules": _url_sql(), "op4_mix": _mix_sql()}


GAP = r"[\x20\x09-\x0D]"
WORDS = rf"list_filter(regexp_split_to_array(coalesce(text, ''), '{GAP}+'), lambda x: x <> '')"


def _quality_sql() -> str:
    from .op1_quality import DELTA, FEATURES, GRID, MIN_WORDS, RISK

    rate = RISK / len(FEATURES)
    share = "CASE WHEN {b} > 0 THEN {a}::double / {b} ELSE 0 END"
    grid = ", ".join(f"('{f}', {c})" for f in FEATURES for c in GRID)
    return rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
    l AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
    g AS (SELECT rid, i, w[i]||chr(1)||w[i + 1]||chr(1)||w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
    r AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS k FROM g) WHERE k > 1) GROUP BY 1),
    c AS (SELECT rid, doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
      len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(l) AS n_lines, length(text) - length(regexp_replace(text, '\p{{Lu}}', '', 'g')) AS n_upper FROM l LEFT JOIN r USING (rid)),
    f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed, {share.format(a="n_symbols", b="word_chars")} AS symbols, {share.format(a="n_upper", b="word_chars")} AS upper,
      {share.format(a="n_dup_lines", b="n_lines")} AS dup_lines, {share.format(a="n_repeat_words", b="n_words")} AS repeats FROM c),
    lab AS (SELECT doc_id, min(quality) AS q FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1),
    h AS (SELECT f.*, q FROM f JOIN lab USING (doc_id) WHERE NOT base_failed),
    long AS ({" UNION ALL ".join(f"SELECT rid, lang, q, '{x}' AS rule, {x} AS v FROM h" for x in FEATURES)}),
    grid(rule, cut) AS (VALUES {grid}),
    hits AS (SELECT lang, rule, cut::double AS cut, sum((q > 0 AND v > cut)::int) AS good, sum((q <= 0 AND v > cut)::int) AS bad FROM long JOIN grid USING (rule) GROUP BY 1, 2, 3),
    strata AS (SELECT lang, sum((q > 0)::int)::bigint AS n, count(*) OVER () * {len(FEATURES) * len(GRID)} AS tests FROM h GROUP BY 1),
    terms AS (SELECT lang, tests, k, exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln({rate}) + (n - k) * ln(1 - {rate})) AS p FROM (SELECT *, unnest(range(0, least(n, ceil(n * {rate})::bigint) + 1)) AS k FROM strata)),
    most AS (SELECT lang, max(CASE WHEN p <= {DELTA} / tests THEN k ELSE -1 END) AS most FROM (SELECT lang, tests, k, sum(p) OVER (PARTITION BY lang ORDER BY k) AS p FROM terms) GROUP BY 1),
    cuts AS (SELECT lang, rule, cut FROM (SELECT hits.lang, rule, cut, row_number() OVER (PARTITION BY hits.lang, rule ORDER BY bad - good DESC, cut DESC) AS r FROM hits JOIN most ON hits.lang IS NOT DISTINCT FROM most.lang WHERE good <= most AND bad > good) WHERE r = 1),
    wide AS (SELECT lang, {", ".join(f"max(CASE WHEN rule = '{x}' THEN cut END) AS cut_{x}" for x in FEATURES)} FROM cuts GROUP BY 1)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR {" OR ".join(f"coalesce({x} > cut_{x}, false)" for x in FEATURES)}) AS kept FROM f LEFT JOIN wide ON f.lang IS NOT DISTINCT FROM wide.lang"""


def _url_sql() -> str:
    from .op3_url_rules import DEFAULT, RULES

    rules = ", ".join(f"('{r}', '{v}')" for r, v in RULES)
    return f"""WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM a),
    c AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM b),
    r AS (SELECT rule, verdict, split_part(rule, '/', 1) AS h, substr(rule, instr(rule, '/')) AS p FROM (VALUES {rules}) t(rule, verdict)),
    m AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM c JOIN r ON (host = h OR ends_with(host, '.'||h)) AND starts_with(path, p) GROUP BY 1)
    SELECT page_id, host, path, m.rule, coalesce(m.verdict, '{DEFAULT}') AS verdict FROM c LEFT JOIN m USING (page_id)"""


def _mix_sql() -> str:
    from .op4_mix import BLOCKS, REPEAT, SEED, SHARE, WEIGHTS

    # Every quotient is a row; the greatest win. W: words in taken blocks before a place of a ring.
    before = lambda x: f"(n_before[least({x} // block, can) + 1] * block + coalesce(n_before[least({x} // block, can) + 2] - n_before[least({x} // block, can) + 1], 0) * ({x} - least({x} // block, can) * block))"
    end = f"({REPEAT} * source_size)"
    laps = " + ".join(f"{before(f'least(pos + {k} * source_size + size, {end})')} - {before(f'(pos + {k} * source_size)')}" for k in range(REPEAT))
    return f"""WITH d AS (SELECT doc_id, source, len({WORDS}) AS size, md5('{SEED}:'||coalesce(doc_id::varchar, '')) AS h FROM documents),
    s0 AS (SELECT source, sum(size)::bigint AS source_size FROM d GROUP BY 1),
    s1 AS (SELECT *, {list(map(float, WEIGHTS))}[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1)::int] AS weight, source_size * {float(REPEAT)} AS cap FROM s0),
    s2 AS (SELECT *, cap / weight AS fill, sum(source_size) OVER () * {float(SHARE)} AS want FROM s1),
    s3 AS (SELECT *, want - coalesce(sum(cap) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest, sum(weight) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_w FROM s2),
    lv AS (SELECT arg_min(rest / rest_w, fill) AS level FROM s3 WHERE rest / rest_w <= fill),
    s4 AS (SELECT *, CASE WHEN level IS NULL THEN cap ELSE least(cap, weight * level) END AS target, greatest(1, floor(want / {BLOCKS}))::bigint AS block FROM s3, lv),
    s5 AS (SELECT *, floor(cap / block)::bigint AS can, floor(want / block + 0.5)::bigint AS house, CASE WHEN source_size > 0 THEN ('0x'||substr(md5('{SEED}/'||coalesce(source, '')), 1, 8))::bigint % source_size ELSE 0 END AS first FROM s4),
    qu AS (SELECT source, house, k, target / (2 * k + 1) AS q FROM (SELECT *, unnest(range(0, can)) AS k FROM s5)),
    won AS (SELECT source, k FROM (SELECT *, row_number() OVER (ORDER BY q DESC, source NULLS LAST, k) AS seat FROM qu) WHERE seat <= house),
    bl AS (SELECT source, i, row_number() OVER (PARTITION BY source ORDER BY i // greatest(1, source_size // block), md5('{SEED}/'||coalesce(source, '')||'#'||i), i) - 1 AS turn FROM (SELECT *, unnest(range(0, can)) AS i FROM s5)),
    ch AS (SELECT bl.source, i, sum((won.k IS NOT NULL)::int) OVER (PARTITION BY bl.source ORDER BY i) AS n FROM bl LEFT JOIN won ON bl.source IS NOT DISTINCT FROM won.source AND turn = k),
    ar AS (SELECT source, list_prepend(0, list(n ORDER BY i)) AS n_before FROM ch GROUP BY 1),
    p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS lo FROM d),
    q AS (SELECT p.doc_id, p.size, s5.*, coalesce(n_before, [0]) AS n_before, CASE WHEN source_size > 0 THEN (lo - first + source_size) % source_size ELSE 0 END AS pos FROM p JOIN s5 ON p.source IS NOT DISTINCT FROM s5.source LEFT JOIN ar ON p.source IS NOT DISTINCT FROM ar.source)
    SELECT doc_id, size, source_size, target, CASE WHEN size > 0 THEN {laps} + {before(f'greatest(pos + size - source_size, 0)')} ELSE 0 END::bigint AS taken FROM q"""
