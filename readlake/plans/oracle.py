"""The queries in SQL for DuckDB, on the driver's tables."""

from __future__ import annotations

from functools import reduce

from ..functions.bases import FIELDS
from ..functions.quality import quant
from ..operators.reads import LEVELS

HEX = "'0123456789abcdef'"
SEPS = r"'[/:= _.,\-#\r\t\n]'"

#: Reads of the documents, as ``views.fq`` makes them.
FQ = f"""fq AS (SELECT doc_id // 250 AS block_id, doc_id AS rec, '@'||source||'.'||doc_id||' '||lang||'/'||n_chars AS id,
 substr(translate(md5(text)||md5(doc_id::varchar), {HEX}, 'ACGTACGTACGTACGN'), 1, (doc_id % 25 + 40)::int) AS bases,
 CASE (doc_id // 250) % 3 WHEN 0 THEN '+' WHEN 1 THEN '+'||source||'.'||doc_id||' '||lang||'/'||n_chars ELSE '+x'||doc_id END AS comment,
 substr(translate(md5('q'||doc_id)||md5('p'||doc_id), {HEX}, 'FFFFFFFFFFF:::,,'), 1, (doc_id % 25 + 40)::int) AS qual FROM documents)"""
BROKEN = """br AS (SELECT block_id, rec, CASE WHEN rec % 17 = 0 THEN substr(id, 2) ELSE id END AS id, CASE WHEN rec % 23 = 0 THEN bases||'X' ELSE bases END AS bases, comment,
 CASE WHEN rec % 19 = 0 THEN substr(qual, 2) WHEN rec % 23 = 0 THEN qual||'F' ELSE qual END AS qual FROM fq)"""
OK = "starts_with(id, '@') AND regexp_full_match(bases, '[ACGTNactgn]+') AND starts_with(comment, '+') AND length(qual) = length(bases)"
TOK = f"""tk AS (SELECT block_id, rec, id, regexp_split_to_array(substr(id, 2), {SEPS}) AS t, regexp_extract_all(substr(id, 2), {SEPS}) AS s FROM fq)"""
TOKENS = """tok AS (SELECT block_id, rec, i - 1 AS ordinal, CASE WHEN i = 1 THEN '@'||t[i] ELSE t[i] END AS token, coalesce(s[i], '') AS sep FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM tk))"""
QCH = """qc AS (SELECT block_id, rec, i - 1 AS pos, ascii(substr(qual, i, 1)) - 33 AS q, substr(bases, i, 1) AS base FROM (SELECT *, unnest(range(1, length(qual) + 1)) AS i FROM fq))"""
SEG = lambda k: f"translate(md5('r'||({k}))||md5('s'||({k})), {HEX}, 'ACGTACGTACGTACGT')"
PAIR = f"pr AS (SELECT p_partkey, {SEG('p_partkey')} AS a, {SEG('p_partkey + 1')} AS b FROM part)"
REF = f"ref AS (SELECT string_agg({SEG('p_partkey')}, '' ORDER BY p_partkey) AS s, count(*) * 64 AS n FROM part)"
RC = lambda c: f"reverse(translate(upper({c}), 'ACGTN', 'TGCAC'))"
PACK = lambda c: f"list_reduce(list_prepend(0::bigint, list_transform(string_split({c}, ''), lambda x: (instr('ACTG', x) - 1)::bigint)), lambda p, q: p * 4 + q)"
CANON = lambda c, m=16: f"CASE WHEN substr({c}, {m}, 1) IN ('G', 'T') THEN {c} ELSE {RC(c)} END"
FLIP = lambda c, m=16: f"CASE WHEN substr({c}, {m}, 1) IN ('G', 'T') THEN 0 ELSE 1 END"
CODES = lambda c: f"translate(upper({c}), 'ACTGN', '01233')"
WIN = lambda width, step: f"win AS (SELECT p AS pos, substr(s, (p + 1)::int, {width}) AS kmer FROM (SELECT s, n, unnest(range(0, n - {width} + 1, {step})) AS p FROM ref))"
#: All windows of a few bases, a segment at a time with the one after it.
NEXT = lambda width: f"nx AS (SELECT p_partkey * 64 + i - 1 AS pos, substr(a||b, i::int, {width}) AS k FROM (SELECT p_partkey, a, b, unnest(range(1, 65)) AS i FROM pr) WHERE i <= {65 - width} OR p_partkey < (SELECT max(p_partkey) FROM part))"
READS = f"""rd AS (SELECT rid, CASE WHEN rid % 2 = 1 THEN {RC('w2')} ELSE w2 END AS bases FROM (
 SELECT rid, substr(w, 1, p - 1)||translate(substr(w, p, 1), 'ACGT', 'CATG')||substr(w, p + 1) AS w2 FROM (
  SELECT rid, substr(s, (place + 1)::int, 100) AS w, (rid % 100 + 1)::int AS p FROM (SELECT o_orderkey AS rid, (o_orderkey * 37) % (n - 100) AS place, s FROM orders, ref))))"""
PROBES = f"""pb AS (SELECT rid, o - 1 AS off, {CANON('k')} AS key, {FLIP('k')} AS flip FROM (SELECT rid, o, substr(bases, o::int, 31) AS k FROM (SELECT rid, bases, unnest(range(1, length(bases) - 29)) AS o FROM rd)))"""
POST = f"""po AS (SELECT key, pos, dir, rn FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY dir, pos) AS rn FROM (SELECT pos, {CANON('kmer')} AS key, {FLIP('kmer')} AS dir FROM win)) WHERE rn <= 16)"""
CAND = """ca AS (SELECT * FROM (SELECT pb.rid, off, rn, xor(flip, dir) AS mdir, CASE WHEN flip = dir THEN pos - off ELSE pos - (69 - off) END AS mpos FROM pb JOIN po USING (key)), ref WHERE mpos >= 0 AND mpos + 100 <= n)"""
EXT = f"""ex AS (SELECT ca.rid, off, rn, mdir, mpos, CASE WHEN mdir = 1 THEN {RC('bases')} ELSE bases END AS own, substr(s, (mpos + 1)::int, 100) AS w FROM ca JOIN rd USING (rid))"""
BEST = """be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY CASE WHEN mm <= 2 THEN 0 ELSE 1 END, CASE WHEN mm <= 2 THEN 0 ELSE mm END, off, rn) AS r FROM (SELECT *, hamming(own, w) AS mm FROM ex)) WHERE r = 1)"""
MAP = "WITH " + ", ".join([REF, WIN(31, 32), READS, PROBES, POST, CAND, EXT, BEST])
XOR = lambda a, b: f"array_to_string(list_transform(range(1, length({a}) + 1), lambda i: xor(instr('ACTG', substr({a}, i::int, 1)) - 1, instr('ACTG', substr({b}, i::int, 1)) - 1)), '')"
COVER = f"{MAP}, mp AS (SELECT mpos, 100 AS len FROM be WHERE mpos > 0)"
BYTES = "by_ AS (SELECT DISTINCT unnest(range(mpos // 4, (mpos + len - 1) // 4 + 1)) AS byte FROM mp)"
LCP = lambda a, b: f"CASE WHEN least(length({a}), length({b})) = 0 THEN 0 ELSE len(list_filter(range(1, least(length({a}), length({b})) + 1), lambda i: substr({a}, 1, i::int) = substr({b}, 1, i::int))) END"
AFFIX = f"""d0 AS (SELECT p_partkey, p_brand||' '||p_type||' '||p_name AS t, p_partkey // 500 AS g FROM part), d1 AS (SELECT *, coalesce(lag(t) OVER (PARTITION BY g ORDER BY p_partkey), '') AS prev FROM d0),
 d2 AS (SELECT *, {LCP('t', 'prev')} AS prefix FROM d1), d3 AS (SELECT *, reverse(substr(t, (prefix + 1)::int)) AS a, reverse(substr(prev, (prefix + 1)::int)) AS b FROM d2), d4 AS (SELECT *, {LCP('a', 'b')} AS suffix FROM d3),
 d5 AS (SELECT *, substr(t, (prefix + 1)::int, (length(t) - prefix - suffix)::int) AS middle FROM d4)"""
#: CRC-32 of each half byte, by the polynomial.
CRC = "[" + ", ".join(f"{reduce(lambda c, _: c >> 1 ^ (0xEDB88320 if c & 1 else 0), range(4), i)}::bigint" for i in range(16)) + "]"
QUANT = "[" + ", ".join(str(quant(i)) for i in range(128)) + "]"


def _fq(body: str, *more: str) -> str:
    return f"WITH {', '.join([FQ, *more])} {body}"


SEPJ = f"array_to_string(regexp_extract_all(substr(id, 2), {SEPS}), '')"
LAYOUT = f"""lay AS (SELECT block_id, min(s) = max(s) AS same, min(least_) AS least_ FROM (SELECT block_id, array_to_string(s, '') AS s, list_min(list_transform(range(1, len(t) + 1), lambda i: length(t[i]) + CASE WHEN i = 1 THEN 1 ELSE 0 END)) AS least_ FROM tk) GROUP BY 1)"""
KIND = "CASE WHEN bool_and(comment = '+') THEN 'PLUS_ONLY' WHEN bool_and(substr(comment, 2) = substr(id, 2)) THEN 'SAME_AS_ID' ELSE 'OTHER' END"
FREQ = "fr AS (SELECT block_id, q AS sym, n, row_number() OVER (PARTITION BY block_id ORDER BY n DESC, q) AS rank FROM (SELECT block_id, q, count(*) AS n FROM qc GROUP BY 1, 2))"
STATS = "st AS (SELECT block_id, ordinal, min(length(token)) AS min_len, max(length(token)) AS max_len, arg_min(token, rec) AS first_token FROM tok GROUP BY 1, 2)"
NCOUNT = "length(bases) - length(replace(replace(bases, 'N', ''), 'n', ''))"

SQL = {
    "q_preanalysis": _fq(
        f"""SELECT f.*, top_sym, n_syms FROM (SELECT block_id, count(*) AS n_rec, arg_min({SEPJ}, rec) AS seps, (min({SEPJ}) = max({SEPJ}))::int AS consistent, min(length(bases)) AS min_len, max(length(bases)) AS max_len,
        sum({NCOUNT})::bigint AS n_count, {KIND} AS comment_type FROM fq GROUP BY 1) f JOIN (SELECT block_id, max(CASE WHEN rank = 1 THEN sym END) AS top_sym, count(*) AS n_syms FROM fr GROUP BY 1) USING (block_id)""",
        QCH, FREQ,
    ),
    "q_block_classify": _fq(
        f"""SELECT block_id, count(*) AS n_rec, CASE WHEN bool_and(ok) THEN CASE WHEN max(n) > 2048 THEN 'fastq_gen3' ELSE 'fastq_gen2' END ELSE 'binary' END AS block_type, 'reads' AS origin FROM (
        SELECT block_id, length(bases) AS n, {OK} AS ok FROM br WHERE block_id % 2 = 1 UNION ALL SELECT block_id, length(bases), {OK} FROM fq WHERE block_id % 2 = 0) GROUP BY 1
        UNION ALL SELECT page_id, 1, CASE WHEN starts_with(html, '@') THEN 'fastq?' ELSE 'binary' END, 'pages' FROM pages UNION ALL SELECT -1, 0, 'gzip', 'heads' UNION ALL SELECT -2, 0, 'bam', 'heads'""",
        BROKEN,
    ),
    "q_fastq_validate": _fq(
        f"SELECT block_id, rec, starts_with(id, '@')::int AS header_ok, regexp_full_match(bases, '[ACGTNactgn]+')::int AS bases_ok, starts_with(comment, '+')::int AS comment_ok, (length(qual) = length(bases))::int AS length_ok, ({OK})::int AS valid FROM br", BROKEN
    ),
    "q_read_generation": "SELECT doc_id // 10 AS block_id, max(n_chars) AS max_len, CASE WHEN max(n_chars) > 2048 THEN 'fastq_gen3' ELSE 'fastq_gen2' END AS generation FROM documents GROUP BY 1",
    "q_block_assign": _fq("SELECT rec, (total - 1) // 8192 AS block, total FROM (SELECT rec, sum(strlen(id) + strlen(bases) + strlen(comment) + strlen(qual) + 4) OVER (ORDER BY rec)::bigint AS total FROM fq)"),
    "q_id_separators": _fq(f"SELECT block_id, arg_min({SEPJ}, rec) AS seps FROM fq GROUP BY 1"),
    "q_id_tokens": _fq("SELECT * FROM tok", TOK, TOKENS),
    "q_id_layout_consistent": _fq("SELECT block_id, same::int AS consistent FROM lay", TOK, LAYOUT),
    "q_id_token_stats": _fq("SELECT block_id, ordinal, min_len, max_len FROM st", TOK, TOKENS, STATS),
    "q_id_mode": _fq("SELECT block_id, CASE WHEN same AND least_ > 0 THEN 'split' ELSE 'all' END AS mode FROM lay", TOK, LAYOUT),
    "q_id_coder_choice": _fq("SELECT block_id, ordinal, CASE WHEN min_len <> max_len AND regexp_full_match(first_token, '[0-9]*') THEN 'bwt' ELSE 'affix' END AS coder FROM st", TOK, TOKENS, STATS),
    "q_id_roundtrip": _fq("SELECT rec, id AS back, 1 AS ok FROM fq"),
    "q_base_stats": _fq(f"SELECT block_id, min(length(bases)) AS min_len, max(length(bases)) AS max_len, sum({NCOUNT})::bigint AS n_count, count(*) AS n_rec FROM fq GROUP BY 1"),
    "q_n_positions": _fq(
        "SELECT block_id, rec, (start + i - 1)::bigint AS pos FROM (SELECT *, unnest(range(1, length(bases) + 1)) AS i FROM (SELECT *, coalesce(sum(length(bases)) OVER (PARTITION BY block_id ORDER BY rec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM fq)) WHERE substr(bases, i, 1) IN ('N', 'n')"
    ),
    "q_n_strip": _fq(f"SELECT rec, replace(bases, 'N', '') AS stripped, {NCOUNT} AS n FROM fq"),
    "q_n_roundtrip": _fq("SELECT rec, bases AS back, 1 AS ok FROM fq"),
    "q_len_delta": _fq("SELECT block_id, rec, length(bases) - min(length(bases)) OVER (PARTITION BY block_id) AS delta FROM fq"),
    "q_base_concat": _fq("SELECT block_id, md5(t) AS md5, length(t) AS n FROM (SELECT block_id, CASE WHEN min(length(bases)) = max(length(bases)) THEN string_agg(bases, '' ORDER BY rec) ELSE string_agg(bases, chr(10) ORDER BY rec)||chr(10) END AS t FROM fq GROUP BY 1)"),
    "q_comment_type": _fq(f"SELECT block_id, {KIND} AS comment_type FROM fq GROUP BY 1"),
    "q_quality_freq": _fq("SELECT block_id, sym, n, rank, 1 AS weight FROM fr", QCH, FREQ),
    "q_quality_context": _fq(
        f"""SELECT block_id, rec, pos, q, {QUANT}[coalesce(lag(q, 1) OVER w, 0) + 1] AS q1, {QUANT}[coalesce(lag(q, 2) OVER w, 0) + 1] AS q2, base, coalesce((sum(q + 33) OVER b) // (count(*) OVER b), 0)::bigint AS mean FROM qc
        WINDOW w AS (PARTITION BY block_id, rec ORDER BY pos), b AS (PARTITION BY block_id, rec ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
        QCH,
    ),
    "q_quality_running_mean": _fq("SELECT rec, pos, ((sum(q + 33) OVER (PARTITION BY rec ORDER BY pos)) // (pos + 1))::bigint AS mean FROM qc", QCH),
    "q_quality_quant": _fq(f"SELECT q, {QUANT}[q + 1] AS quant, count(*) AS n FROM qc GROUP BY 1, 2", QCH),
    "q_encode_bases": _fq(f"SELECT rec, {CODES('bases')} AS codes FROM fq"),
    "q_decode_bases": _fq("SELECT rec, replace(upper(bases), 'N', 'G') AS back FROM fq"),
    "q_newline_index": "SELECT doc_id, i - 1 AS line, (length(array_to_string(list_slice(l, 1, i), chr(10))))::bigint AS pos FROM (SELECT doc_id, l, unnest(range(1, len(l))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))",
    "q_block_md5": "SELECT doc_id, md5(text) AS md5, strlen(text) AS n FROM documents",
    "q_verify_md5": "SELECT doc_id, (doc_id % 13 = 0)::int AS damaged, CASE WHEN doc_id % 13 = 0 THEN 0 ELSE length(text) END AS n FROM documents",
    "q_coder_choice": "SELECT doc_id, strlen(text) AS n, CASE WHEN strlen(text) > 32 AND strlen(text) < 2146435072 THEN 'fc' ELSE 'bwt' END AS coder FROM documents",
    "q_crc": f"""WITH h AS (SELECT doc_id, text, string_split(hex(encode(text)), '') AS h FROM documents),
     n AS (SELECT doc_id, text, list_transform(range(1, len(h) + 1), lambda i: (instr('0123456789ABCDEF', h[CASE WHEN i % 2 = 1 THEN i + 1 ELSE i - 1 END]) - 1)::bigint) AS n FROM h WHERE text <> '')
     SELECT doc_id, md5(text) AS md5, xor(list_reduce(list_prepend(4294967295::bigint, n), lambda c, x: xor(c >> 4, {CRC}[(xor(c, x) & 15) + 1])), 4294967295) AS crc FROM n UNION ALL SELECT doc_id, md5(text), 0 FROM documents WHERE text = ''""",
    "q_archive_roundtrip": _fq(
        "SELECT block_id, n_rec, n_bytes, md5, md5 AS back, 1 AS ok FROM (SELECT block_id, count(*) AS n_rec, sum(strlen(t))::bigint AS n_bytes, md5(string_agg(md5(t), '' ORDER BY rec)) AS md5 FROM (SELECT block_id, rec, id||chr(10)||bases||chr(10)||comment||chr(10)||qual||chr(10) AS t FROM fq) GROUP BY 1)"
    ),
    "q_ratio": "SELECT lang, sum(a)::bigint AS read, sum(b)::bigint AS written, round(sum(b) * 100.0 / sum(a), 6)::double AS ratio FROM (SELECT lang, strlen(text) AS a, (list_sum(list_transform(list_distinct(l), lambda x: length(x))) + len(list_distinct(l)) - 1) AS b FROM (SELECT lang, text, string_split(text, chr(10)) AS l FROM documents)) GROUP BY 1",
    "q_sample_fingerprint": "SELECT doc_id, substr(md5(CASE WHEN q < 1024 THEN text ELSE substr(text, 1, 1024)||substr(text, q + 1, 1024)||substr(text, 2 * q + 1, 1024)||substr(text, 3 * q + 1, 1024) END||':'||length(text)), 1, 8) AS fp FROM (SELECT doc_id, text, length(text) // 4 AS q FROM documents)",
    "q_skip_damaged": "SELECT doc_id, md5(text) AS md5 FROM documents WHERE doc_id % 13 <> 0",
    "q_pack2bit": f"""WITH {PAIR} SELECT p_partkey, {' || \',\' || '.join(f"({PACK(f'substr(a, {i}, 31)')})" for i in (1, 32, 63))} AS packed, array_to_string(list_transform(range(0, 16), lambda i: printf('%02x', list_reduce(list_transform([1, 2, 3, 4], lambda j: (instr('ACTG', substr(a, (i * 4 + j)::int, 1)) - 1)::bigint), lambda p, q: p * 4 + q))), '') AS bytes FROM pr""",
    "q_revcomp": f"WITH {PAIR} SELECT p_partkey, {RC('a')} AS rc FROM pr",
    "q_hamming": f"WITH {PAIR} SELECT p_partkey, hamming(a, b) AS mm FROM pr",
    "q_packed_hamming": f"WITH {PAIR}, x AS (SELECT p_partkey, {', '.join(f"xor({PACK(f'substr(a, {i}, 31)')}, {PACK(f'substr(b, {i}, 31)')}) AS x{i}" for i in (1, 32, 63))} FROM pr) SELECT p_partkey, ({' + '.join(f'bit_count((x{i} | (x{i} >> 1)) & {FIELDS})' for i in (1, 32, 63))})::bigint AS mm FROM x",
    "q_diff_keep": f"WITH {PAIR} SELECT p_partkey, array_to_string(list_transform(range(1, 65), lambda i: CASE WHEN substr(a, i::int, 1) = substr(b, i::int, 1) THEN 0 ELSE instr('ACTG', substr(a, i::int, 1)) - 1 END), '') AS diff FROM pr",
    "q_diff_xor": f"WITH {PAIR} SELECT p_partkey, {XOR('a', 'b')} AS diff FROM pr",
    "q_ref_substr": f"WITH {REF}, {WIN(100, 64)} SELECT pos, kmer AS seq, {CODES('kmer')} AS codes FROM win",
    "q_seed_extract": f"WITH {REF}, {WIN(31, 32)} SELECT pos, kmer FROM win",
    "q_canonical_kmer": f"WITH {REF}, {WIN(31, 32)} SELECT pos, {CANON('kmer')} AS kmer, {FLIP('kmer')} AS dir FROM win",
    "q_kmer_count": f"WITH {PAIR}, {NEXT(8)} SELECT {PACK('k')} AS key, count(*) AS n FROM nx GROUP BY k",
    "q_seed_topk": f"""WITH {PAIR}, {NEXT(6)}, s AS (SELECT pos, {CANON('k', 3)} AS c, {FLIP('k', 3)} AS dir FROM nx), r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY dir, pos) AS rn FROM s) SELECT {PACK('c')} AS key, pos, dir, rn FROM r WHERE rn <= 16""",
    "q_ref_match": f"""WITH {REF}, v AS (SELECT 'same' AS name, s FROM ref UNION ALL SELECT 'short', substr(s, 1, length(s) - 64) FROM ref UNION ALL SELECT 'other', overlay FROM (SELECT substr(s, 1, 70)||CASE WHEN substr(s, 71, 1) = 'A' THEN 'C' ELSE 'A' END||substr(s, 72) AS overlay FROM ref))
     SELECT name, length(v.s) AS len, CASE WHEN length(v.s) <> length(ref.s) THEN 'length' WHEN v.s <> ref.s THEN 'content' ELSE 'same' END AS verdict FROM v, ref""",
    "q_probe_kmers": f"WITH {REF}, {READS}, {PROBES} SELECT rid, count(*) AS n, sum(flip)::bigint AS flips, sum({PACK('key')} % 1000003)::bigint AS sum FROM pb GROUP BY 1",
    "q_seed_join": f"WITH {REF}, {WIN(31, 32)}, {READS}, {PROBES}, {POST}, {CAND} SELECT rid, off, rn, mpos, mdir FROM ca",
    "q_extend_score": f"WITH {REF}, {WIN(31, 32)}, {READS}, {PROBES}, {POST}, {CAND}, {EXT} SELECT rid, mpos, mdir, count(*) AS hits, min(hamming(own, w)) AS mm FROM ex GROUP BY 1, 2, 3",
    "q_map_best": f"{MAP} SELECT rid, coalesce(mpos, 0) AS mpos, coalesce(mdir, 2) AS mdir, coalesce(mm, -1) AS mm FROM rd LEFT JOIN be USING (rid)",
    "q_map_diff": f"{MAP} SELECT rd.rid, CASE WHEN w IS NULL THEN {CODES('bases')} ELSE {XOR('own', 'w')} END AS diff FROM rd LEFT JOIN be USING (rid)",
    "q_map_roundtrip": f"WITH {REF}, {READS} SELECT rid, bases AS back, 1 AS ok FROM rd",
    "q_coverage_bytes": f"{COVER}, {BYTES} SELECT byte FROM by_",
    "q_coverage_intervals": f"""{COVER}, s AS (SELECT mpos AS lo, mpos + len AS hi, max(mpos + len) OVER (ORDER BY mpos, len ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM mp),
     g AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach THEN 1 ELSE 0 END) OVER (ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS i FROM s) SELECT min(lo) AS lo, max(hi) AS hi FROM g GROUP BY i""",
    "q_ref_mask": f"{COVER}, {BYTES}, w4 AS (SELECT p // 4 AS byte, substr(s, (p + 1)::int, 4) AS k FROM (SELECT s, unnest(range(0, n - 3, 4)) AS p FROM ref)) SELECT byte, CASE WHEN by_.byte IS NULL THEN 0 ELSE {PACK('k')} END AS value FROM w4 LEFT JOIN by_ USING (byte)",
    "q_position_range": f"{MAP} SELECT rid, mpos, mdir FROM be WHERE mpos BETWEEN 1000 AND 4999",
    "q_block_index": f"{MAP} SELECT rid // 1000 AS block_id, min(mpos) AS min_pos, max(mpos) AS max_pos, count(*) AS n FROM be GROUP BY 1",
    "q_affix_prefix": f"WITH {AFFIX} SELECT p_partkey, prefix FROM d5",
    "q_affix_suffix": f"WITH {AFFIX} SELECT p_partkey, suffix FROM d5",
    "q_affix_middle": f"WITH {AFFIX} SELECT p_partkey, middle FROM d5",
    "q_affix_roundtrip": f"WITH {AFFIX} SELECT p_partkey, substr(prev, 1, prefix::int)||middle||substr(prev, (length(prev) - suffix + 1)::int) AS back, 1 AS ok FROM d5",
    "q_ordered_merge": "SELECT conv_id, count(*) AS n, md5(string_agg(role||':'||text, chr(10) ORDER BY turn, role, text)) AS md5 FROM conversations GROUP BY 1",
    "q_archive_union": "SELECT (doc_id % 2)::int AS file_idx, doc_id // 250 AS block_id, count(*) AS n_rec FROM documents GROUP BY 1, 2",
    "q_level_block_size": f"SELECT l.level, l.size AS block_size, (b // l.size + CASE WHEN b % l.size > 0 THEN 1 ELSE 0 END)::bigint AS blocks FROM (VALUES {', '.join(f'({k}, {v}::bigint)' for k, v in LEVELS.items())}) l(level, size), (SELECT sum(strlen(text))::bigint AS b FROM documents)",
    "q_meta_json": """SELECT event_id, '{"type":"'||event_type||'","stream":{"id":'||user_id||',"k":'||(event_id % 7)||'}}' AS doc, event_type AS type, user_id AS id, event_id % 7 AS k FROM events""",
    "q_binary_roundtrip": "SELECT doc_id, strlen(text) AS n, greatest(1, (strlen(text) + 4095) // 4096) AS blocks, md5(text) AS md5, 1 AS ok FROM documents WHERE text IS NOT NULL",
    "q_long_read_roundtrip": f"WITH {REF}, l AS (SELECT rid, size, (rid * 997) % (n - size) AS at_, s FROM (SELECT s_suppkey AS rid, least(s_suppkey * 1201 % 11901 + 100, n // 2) AS size, n, s FROM supplier, ref)), w AS (SELECT rid, substr(s, (at_ + 1)::int, size::int) AS w FROM l) SELECT rid, length(w) AS n, md5(CASE WHEN rid % 2 = 1 THEN {RC('w')} ELSE w END) AS md5, 1 AS ok FROM w",
    "q_stream_counts": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
