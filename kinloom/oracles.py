"""SQL that gives the rows of the queries, for an engine with lists and lambdas."""

from __future__ import annotations

from kinloom.functions import lexicon as lex

CAP, MIN_TERMS, M_MULT = 5000, 2, 4
KS = {"joint": 30, "addr": 20, "name": 10, "cgram": 10, "name_noaddr": 10, "native": 10, "cgram_noaddr": 10, "joint_rev": 2}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _map(name: str, table: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"{_quoted(k)}: {_quoted(v)}" for k, v in table.items()) + f"}}[{name}]"


def _list(words) -> str:
    return "[" + ", ".join(map(_quoted, words)) + "]"


def _split(text: str, pattern: str) -> str:
    return f"list_filter(string_split_regex({text}, '{pattern}'), lambda t: t <> '')"


REC = """rec AS (
  SELECT doc_id AS rid, 'S' || (doc_id % 3 + 1) || '-' || lpad(doc_id::VARCHAR, 7, '0') AS entity_id, lines[1] AS name,
    CASE WHEN len(lines) > 1 THEN lines[len(lines)] ELSE '' END AS address, lang AS country, (doc_id % 3 + 1)::INT AS source
  FROM (SELECT *, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))"""


def fold_sql(text: str) -> str:
    return f"lower(regexp_replace(strip_accents({text}), '[^\\x00-\\x7f]', '', 'g'))"


def skeleton_sql(token: str) -> str:
    out = token
    for sound, sign in lex.SKELETON_REWRITES:
        out = f"replace({out}, '{sound}', '{sign}')"
    out = f"translate({out}, '{lex.SKELETON_LETTERS[0]}', '{lex.SKELETON_LETTERS[1]}')"
    out = f"regexp_replace(substr({out}, 1, 1), '[aeiou]', 'a') || regexp_replace(substr({out}, 2), '[aeiouh]', '', 'g')"
    for c in "abcdefghijklmnopqrstuvwxyz0123456789":
        out = f"regexp_replace({out}, '{c}{c}+', '{c}', 'g')"
    return f"CASE WHEN regexp_full_match({token}, '[0-9]*') THEN {token} ELSE {out} END"


def numbers_sql(text: str) -> str:
    """First occurrences of the numbers of a text, in order."""
    found = f"list_transform(regexp_extract_all({text}, '[0-9]+'), lambda n: regexp_replace(n, '^0+([0-9]+)$', '\\1'))"
    return f"list_reduce(list_transform({found}, lambda n: [n]), lambda acc, n: CASE WHEN list_contains(acc, n[1]) THEN acc ELSE acc || n END, []::VARCHAR[])"


def norm(source: str, keys: str) -> str:
    """CTEs up to ``norm``: keys, name, nn, nc, nk, sk, an, num, native, web and the token lists."""
    dba = r"\b(?:d\s*/\s*b\s*/\s*a|dba|doing business as|trading as|t\s*/\s*a|aka|a\.k\.a\.?)\b\s*:?"
    idle = _list(sorted({*lex.LEGAL_FORMS.values(), *lex.NAME_STOP_WORDS}))
    digit = "CASE WHEN regexp_matches(substr(s, i, 1), '[0135]') AND ((i > 1 AND regexp_matches(substr(s, i - 1, 3), '^[a-z].[a-z]$')) OR (i > 3 AND regexp_matches(substr(s, i - 3, 5), '^[a-z]{3}[0135]([^A-Za-z0-9_]|$)'))) THEN translate(substr(s, i, 1), '0135', 'oies') ELSE substr(s, i, 1) END"
    short = "regexp_replace(t, '^0+([0-9]+(?:st|nd|rd|th)?)$', '\\1')"
    return rf"""n0 AS (
  SELECT {keys}, name, {fold_sql(r"regexp_replace(name, '\b([A-Z]+)l([A-Z]+)\b', '\1I\2', 'g')")} AS s,
    replace(replace({fold_sql("address")}, 'n/a', ' '), 'c/o', ' ') AS f FROM {source}),
n1 AS (SELECT * REPLACE (regexp_replace(s, '\(\s*id\s*:?\s*\d+\s*\)', ' ', 'g') AS s) FROM n0),
n2 AS (SELECT * REPLACE (CASE WHEN regexp_matches(string_split_regex(s, '{dba}')[-1], '\S') THEN string_split_regex(s, '{dba}')[-1] ELSE s END AS s) FROM n1),
n3 AS (SELECT * REPLACE (regexp_replace(regexp_replace(regexp_replace(s, 'https?://|www\.', ' ', 'g'), '\.(?:co\.in|com|net|org|in|co|biz|info|fr|us)\b', ' ', 'g'), '^\s*m\s*/\s*s\b\.?', ' ') AS s) FROM n2),
n4 AS (SELECT * REPLACE (replace(replace(replace(replace(s, '&', ' and '), '''', ''), '`', ''), '.', '') AS s) FROM n3),
n5 AS (SELECT * REPLACE (array_to_string(list_transform(range(1, length(s) + 1), lambda i: {digit}), '') AS s) FROM n4),
n6 AS (SELECT *, list_transform({_split("s", "[^a-z0-9]+")}, lambda t: coalesce({_map("t", lex.LEGAL_FORMS)}, t)) AS t0 FROM n5),
n7 AS (SELECT *, t0[coalesce(list_filter(range(1, len(t0) + 1), lambda i: NOT list_contains({_list(lex.HONORIFICS)}, t0[i]))[1], len(t0)):] AS toks FROM n6),
n8 AS (SELECT *, list_filter(toks, lambda t: NOT list_contains({idle}, t)) AS c0 FROM n7),
n9 AS (SELECT *, CASE WHEN len(c0) > 0 THEN c0 ELSE toks END AS c1 FROM n8),
n10 AS (SELECT *, CASE WHEN len(c1) = 1 AND regexp_full_match(c1[1], '.{{5,}}com') THEN [regexp_replace(c1[1], 'com$', '')] ELSE c1 END AS core,
    list_filter(list_transform({_split("f", "[^a-z0-9]+")}, lambda t: coalesce({_map(short, lex.ADDRESS_FORMS)}, {short})), lambda t: NOT list_contains({_list(lex.ADDRESS_NOISE)}, t)) AS adr,
    {numbers_sql("f")} AS nums FROM n9),
norm AS MATERIALIZED (
  SELECT {keys}, name, coalesce(array_to_string(toks, ' '), '') AS nn, coalesce(array_to_string(core, ' '), '') AS nc, coalesce(array_to_string(core, ''), '') AS nk,
    list_transform(core, lambda t: {skeleton_sql("t")}) AS sks, core, adr, nums,
    coalesce(array_to_string(adr, ' '), '') AS an, coalesce(array_to_string(nums, ' '), '') AS num,
    regexp_matches(name, '[ऀ-ൿ]') AS native, regexp_matches(name, '(?i)(\.com|\.in\b|\.net|\.org|www\.|^@)') AS web FROM n10)"""


BASE = f"{REC},\n{norm('rec', 'rid, entity_id, country, source')}"
NAME_TERMS = "list_concat(list_transform(core, lambda t: 'n' || t), list_transform(list_filter(sks, lambda t: t <> ''), lambda t: 's' || t))"
ADDRESS_TERMS = "list_concat(list_transform(adr, lambda t: 'a' || t), list_transform(range(1, len(adr)), lambda i: 'b' || adr[i] || '_' || adr[i + 1]))"
GRAM_TERMS = "CASE WHEN length(nk) <= 2 THEN ['c^' || nk || '$'] ELSE list_transform(range(1, length(nk)), lambda i: 'c' || substr('^' || nk || '$', i, 4)) END"
CHANNELS = {
    "joint": (f"list_concat({NAME_TERMS}, {ADDRESS_TERMS})", "true"), "addr": (ADDRESS_TERMS, "true"), "name": (NAME_TERMS, "true"),
    "cgram": (GRAM_TERMS, "web OR (length(nk) >= 8 AND NOT contains(nc, ' '))"), "name_noaddr": (NAME_TERMS, "an = ''"),
    "native": (f"list_concat(list_transform(list_filter(sks, lambda t: t <> ''), lambda t: 's' || t), {ADDRESS_TERMS})", "native"), "cgram_noaddr": (GRAM_TERMS, "an = ''"),
}


def retrieve(channel: str, k: int | None = None, cap: int = CAP) -> str:
    """CTEs up to ``r_<channel>``: s1, p, score, rank."""
    k = k or KS[channel]
    reverse, base = channel.endswith("_rev"), channel.removesuffix("_rev")
    terms, pool = CHANNELS[base]
    c, searched = channel, "NOT pool" if reverse else "pool"
    a, b = ("p", "q") if reverse else ("q", "p")
    return f"""t_{c} AS MATERIALIZED (
  SELECT rid, country, source > 1 AS pool, unnest(list_distinct({terms})) AS term FROM norm WHERE source = 1 OR ({pool})),
z_{c} AS (SELECT country, count(*) AS n, count(*) FILTER (source > 1) AS n_pool FROM norm WHERE source = 1 OR ({pool}) GROUP BY country),
i_{c} AS (
  SELECT t.country, term, count(*) FILTER ({searched}) AS df, ln(1 + any_value(n)::DOUBLE / count(*)) AS idf
  FROM t_{c} t JOIN z_{c} z ON t.country = z.country AND n_pool > 0 AND n > n_pool GROUP BY t.country, term),
w_{c} AS MATERIALIZED (
  SELECT t.country, rid, NOT ({searched}) AS asks, term, df, idf / greatest(sqrt(sum(idf * idf) OVER (PARTITION BY rid)), 1e-12) AS w
  FROM t_{c} t JOIN i_{c} i USING (country, term)),
q_{c} AS MATERIALIZED (
  SELECT country, term, rid AS q, w AS wq, df <= {cap} OR row_number() OVER (PARTITION BY rid ORDER BY df, term) <= {MIN_TERMS} AS used
  FROM w_{c} WHERE asks AND df > 0),
p_{c} AS MATERIALIZED (SELECT country, term, rid AS p, w AS wp FROM w_{c} WHERE NOT asks),
a_{c} AS (SELECT q, p, sum(wq * wp) AS s FROM q_{c} JOIN p_{c} USING (country, term) WHERE used GROUP BY q, p),
s_{c} AS MATERIALIZED (SELECT * FROM a_{c} QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(s, 6) DESC, p) <= {M_MULT * k}),
m_{c} AS (
  SELECT s.q, s.p, sum(wq * wp) AS more FROM s_{c} s JOIN q_{c} x ON s.q = x.q AND NOT used JOIN p_{c} y ON y.p = s.p AND y.term = x.term GROUP BY s.q, s.p),
e_{c} AS (SELECT s.q, s.p, round(s + coalesce(more, 0), 6) AS score FROM s_{c} s LEFT JOIN m_{c} m ON s.q = m.q AND s.p = m.p),
r_{c} AS MATERIALIZED (
  SELECT {a} AS s1, {b} AS p, score, (row_number() OVER (PARTITION BY q ORDER BY score DESC, p) - 1)::INT AS rank FROM e_{c}
  QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, p) <= {k})"""


JOINT = f"WITH {BASE},\n{retrieve('joint')},\nscored AS (SELECT s1, p, score AS prob FROM r_joint)"
TRUTH = r"""texts AS (SELECT doc_id, lang, doc_id % 3 + 1 AS source, trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g')) AS t FROM documents),
firsts AS (SELECT lang, t, min(doc_id) AS s1 FROM texts WHERE source = 1 GROUP BY ALL),
truth AS (SELECT s1, doc_id AS p FROM texts JOIN firsts USING (lang, t) WHERE source > 1)"""
BEST = "best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY p ORDER BY prob DESC, s1) = 1)"
F05 = "CASE WHEN 0.25 * n_true + n_pred > 0 THEN 1.25 * tp / (0.25 * n_true + n_pred) ELSE 1.0 END"
ENTITY = f"""judged AS (
  SELECT s1, (SELECT count(*) FROM pred b WHERE b.s1 = e.s1) AS n_pred, (SELECT count(*) FROM truth b WHERE b.s1 = e.s1) AS n_true,
    (SELECT count(*) FROM pred b JOIN truth t ON b.s1 = t.s1 AND b.p = t.p WHERE b.s1 = e.s1) AS tp, country
  FROM (SELECT rid AS s1, country FROM norm WHERE source = 1) e),
per_entity AS (SELECT *, {F05} AS f05 FROM judged)"""
DECIDED = f"{JOINT},\n{TRUTH},\n{BEST},\npred AS (SELECT s1, p FROM best WHERE prob >= 0.6)"
SUMMARY = """round(avg(f05), 6) AS macro_f05, round(avg(f05) FILTER (n_true > 0), 6) AS f05_matched_entities, round(avg(f05) FILTER (n_true = 0), 6) AS f05_singletons,
  round(sum(tp)::DOUBLE / nullif(sum(n_pred), 0), 6) AS pair_precision, round(sum(tp)::DOUBLE / nullif(sum(n_true), 0), 6) AS pair_recall, count(*) AS n_entities, sum(n_pred)::BIGINT AS n_pred_pairs"""


def lists(pairs: str, column: str) -> str:
    return f"""SELECT entity_id AS source1_entity_id, coalesce(l, '') AS {column} FROM (SELECT * FROM norm WHERE source = 1) o LEFT JOIN (
  SELECT s1, string_agg(entity_id, ',' ORDER BY p) AS l FROM {pairs} x JOIN (SELECT rid, entity_id FROM norm) n ON n.rid = x.p GROUP BY s1) f ON f.s1 = o.rid"""


def _union_sql() -> str:
    cols = ", ".join(f"coalesce(max(score) FILTER (channel = '{c}'), 0.0) AS score_{c}, coalesce(max(rank) FILTER (channel = '{c}'), {k}) AS rank_{c}" for c, k in KS.items())
    every = " UNION ALL ".join(f"SELECT '{c}' AS channel, * FROM r_{c}" for c in KS)
    ctes = ",\n".join(retrieve(c) for c in KS)
    return f"WITH {BASE},\n{ctes},\nu AS (SELECT s1, p, {cols} FROM ({every}) GROUP BY s1, p)\nSELECT * REPLACE (CASE WHEN score_joint = 0 THEN score_joint_rev ELSE score_joint END AS score_joint) FROM u"


def _rarity_sql() -> str:
    out = ["rid"]
    for c in ("nc", "nk", "an"):
        s, p = f"count(*) FILTER (source = 1) OVER (PARTITION BY country, {c})", f"count(*) FILTER (source > 1) OVER (PARTITION BY country, {c})"
        ns, np_ = "count(*) FILTER (source = 1) OVER (PARTITION BY country)", "count(*) FILTER (source > 1) OVER (PARTITION BY country)"
        for name, value in ((f"{c}_s1r", f"ln(1 + {s}::DOUBLE / greatest({ns}, 1) * 1e6)"), (f"{c}_poolr", f"ln(1 + {p}::DOUBLE / greatest({np_}, 1) * 1e6)"), (f"{c}_s1n", f"ln(1 + {s})"), (f"{c}_pooln", f"ln(1 + {p})")):
            out.append(f"CASE WHEN {c} <> '' THEN round({value}, 6) END AS {name}")
    return f"WITH {BASE}\nSELECT {', '.join(out)} FROM norm"


COMPETITION = """comp AS (
  SELECT p, max(score) AS max1, coalesce(max(score) FILTER (r = 2), 0.0) AS max2, max(s1) FILTER (r = 1) AS best_s1, count(*) AS n
  FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY score DESC, s1) AS r FROM r_joint) GROUP BY p)"""


def _numbers(t: str) -> str:
    return f"list_transform({t}, lambda v: substr(v, 1, 9)::BIGINT)"


def oracle_sql() -> dict[str, str]:
    out = {
        "er_records": f"WITH {REC} SELECT * FROM rec",
        "er_truth_pairs": f"WITH {TRUTH} SELECT * FROM truth",
        "er_name_norm": f"WITH {BASE} SELECT rid, nn, nc, nk, coalesce(array_to_string(sks, ' '), '') AS sk FROM norm",
        "er_address_norm": f"WITH {BASE} SELECT rid, an, num FROM norm",
        "er_party_names": f"""WITH parties AS (SELECT 'c' AS side, c_custkey AS id, c_name AS name, c_name AS address FROM customer UNION ALL SELECT 's', s_suppkey, s_name, s_name FROM supplier),
{norm("parties", "side, id")} SELECT side, id, nn, nc, nk, coalesce(array_to_string(sks, ' '), '') AS sk, an, num FROM norm""",
        "er_flags": f"""WITH {REC}, named AS (SELECT 'page' AS kind, page_id AS id, url AS name, '' AS address FROM pages UNION ALL SELECT 'doc', rid, name, '' FROM rec),
{norm("named", "kind, id")} SELECT kind, id, web, native, length(nk) >= 8 AS long FROM norm""",
        "er_fold": f"SELECT doc_id, sha256({fold_sql('text')}) AS folded FROM documents",
        "er_skeletons": f"WITH w AS (SELECT DISTINCT unnest({_split('lower(text)', '[^a-z]+')}) AS word FROM documents) SELECT word, {skeleton_sql('word')} AS sk FROM w",
        "er_streets": f"""WITH f AS (SELECT doc_id, replace(replace({fold_sql("coalesce(text, '')")}, 'n/a', ' '), 'c/o', ' ') AS f FROM documents)
SELECT doc_id, coalesce(array_to_string({numbers_sql("f")}, ' '), '') AS num,
  regexp_extract(' ' || replace(coalesce(array_to_string({_split("f", "[^a-z0-9]+")}, ' '), ''), ' ', '  ') || ' ', ' [0-9]+  ([a-z]{{3,}}) ', 1) AS street FROM f""",
        "er_candidates_union": _union_sql(),
        "er_labelled_pairs": f"{JOINT},\n{TRUTH}\nSELECT s.*, t.p IS NOT NULL AS label FROM scored s LEFT JOIN truth t ON s.s1 = t.s1 AND s.p = t.p",
        "er_recall_at_k": f"""WITH {BASE},\n{", ".join(retrieve(c) for c in ("joint", "addr", "name"))},\n{TRUTH},
c AS (SELECT 'joint' AS channel, * FROM r_joint UNION ALL SELECT 'addr', * FROM r_addr UNION ALL SELECT 'name', * FROM r_name),
w AS (SELECT DISTINCT channel, k::INT AS k, s1, p FROM (SELECT * FROM c UNION ALL SELECT * REPLACE ('all' AS channel) FROM c) x, (SELECT unnest([1, 2, 5]) AS k) g WHERE rank < k)
SELECT channel, k, round(count(t.p)::DOUBLE / (SELECT count(*) FROM truth), 6) AS pair_recall, round(count(*)::DOUBLE / (SELECT count(*) FROM norm WHERE source = 1), 6) AS cands_per_s1
FROM w LEFT JOIN truth t ON w.s1 = t.s1 AND w.p = t.p GROUP BY channel, k""",
        "er_blocking_report": f"""{JOINT},\n{TRUTH},\npred AS (SELECT s1, p FROM scored),\n{ENTITY}
SELECT round(sum(tp)::DOUBLE / sum(n_true), 6) AS pair_recall, round(avg(n_pred), 6) AS cands_per_s1, round(avg((tp = n_true)::INT), 6) AS entities_full_recall,
  round(avg(CASE WHEN 0.25 * n_true + tp > 0 THEN 1.25 * tp / (0.25 * n_true + tp) ELSE 1.0 END), 6) AS oracle_macro_f05 FROM judged""",
        "er_recall_by": f"""{JOINT},\n{TRUTH}\nSELECT a.country, b.source AS src, round(avg((s.p IS NOT NULL)::INT), 6) AS recall
FROM truth t LEFT JOIN scored s ON s.s1 = t.s1 AND s.p = t.p JOIN norm a ON a.rid = t.s1 JOIN norm b ON b.rid = t.p GROUP BY ALL""",
        "er_rarity": _rarity_sql(),
        "er_part_rarity": "SELECT p_brand AS country, p_name AS value, count(*) FILTER (p_partkey % 3 = 0) AS s1_n, count(*) FILTER (p_partkey % 3 > 0) AS pool_n FROM part WHERE p_name <> '' GROUP BY ALL",
        "er_pool_competition": f"""{JOINT},\n{COMPETITION}\nSELECT c.*, round(ln(1 + c.n / ({KS["joint"]} * z.s / greatest(z.q, 1)::DOUBLE)), 6) AS nrel FROM comp c JOIN norm r ON r.rid = c.p
JOIN (SELECT country, count(*) FILTER (source = 1) AS s, count(*) FILTER (source > 1) AS q FROM norm GROUP BY country) z ON z.country = r.country""",
        "er_margins": f"{JOINT},\n{COMPETITION}\nSELECT s1, p, round(score - CASE WHEN s1 = best_s1 THEN max2 ELSE max1 END, 6) AS margin, round(ln(1 + n), 6) AS lists FROM r_joint JOIN comp USING (p)",
        "er_group_context": f"""{JOINT}\nSELECT s1, p, round(prob - max(prob) OVER (PARTITION BY s1), 6) AS gap, (rank() OVER (PARTITION BY s1 ORDER BY prob DESC))::INT AS rk,
  count(*) OVER (PARTITION BY s1) AS n_cands FROM scored""",
        "er_sibling_context": f"""{JOINT},
x AS (SELECT s.*, n.source AS src, row_number() OVER (PARTITION BY s1 ORDER BY prob DESC, p) AS st_rank, (prob > 0.5)::INT AS hi FROM scored s JOIN norm n ON n.rid = s.p)
SELECT s1, p, round(sum(prob) OVER (PARTITION BY s1) - prob, 6) AS st_sum_other,
  round(CASE WHEN prob >= max(prob) OVER (PARTITION BY s1) THEN coalesce(max(prob) FILTER (st_rank = 2) OVER (PARTITION BY s1), 0) ELSE max(prob) OVER (PARTITION BY s1) END, 6) AS st_max_other,
  round(sum(prob) OVER (PARTITION BY s1, src) - prob, 6) AS st_src_sum_other, st_rank::INT AS st_rank, (row_number() OVER (PARTITION BY s1, src ORDER BY prob DESC, p))::INT AS st_src_rank,
  (sum(hi) OVER (PARTITION BY s1) - hi)::BIGINT AS st_nhi_other, (sum(hi) OVER (PARTITION BY s1, src) - hi)::BIGINT AS st_src_nhi_other FROM x""",
        "er_token_sets": f"""{JOINT}\nSELECT s1, p, CASE WHEN ok THEN round(common / len(list_distinct(list_concat(x, y)))::DOUBLE, 6) END AS jac, CASE WHEN ok THEN list_contains(y, x[1]) END AS first,
  CASE WHEN ok THEN common END AS shared FROM (SELECT s1, p, a.core AS x, b.core AS y, len(a.core) > 0 AND len(b.core) > 0 AS ok, len(list_intersect(a.core, b.core))::INT AS common
  FROM scored s JOIN norm a ON a.rid = s.s1 JOIN norm b ON b.rid = s.p)""",
        "er_house_numbers": f"""WITH h AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, {numbers_sql("lower(html)")} AS a FROM pages),
x AS (SELECT *, lag(a) OVER (PARTITION BY host ORDER BY page_id) AS b FROM h), y AS (SELECT *, len(a) > 0 AND len(b) > 0 AS ok FROM x WHERE b IS NOT NULL),
z AS (SELECT *, {_numbers("a")} AS m, {_numbers("b")} AS n FROM y)
SELECT page_id, CASE WHEN ok THEN a[1] = b[1] END AS hn_eq, CASE WHEN ok THEN levenshtein(a[1], b[1])::INT END AS hn_lev, CASE WHEN ok THEN round(ln(1 + abs(m[1] - n[1])), 6) END AS hn_logdiff,
  CASE WHEN ok THEN round(abs(m[1] - n[1]) / greatest(m[1], n[1], 1)::DOUBLE, 6) END AS hn_reldiff,
  CASE WHEN ok THEN round(ln(1 + list_min(list_transform(m, lambda u: list_min(list_transform(n, lambda v: abs(u - v)))))), 6) END AS num_min_logdiff,
  CASE WHEN ok THEN round(len(list_intersect(a, b)) / len(a)::DOUBLE, 6) END AS num_a_in_b, CASE WHEN ok THEN round(len(list_intersect(a, b)) / len(b)::DOUBLE, 6) END AS num_b_in_a FROM z""",
        "er_jaro_winkler": f"{JOINT}\nSELECT s1, p, round(jaro_winkler_similarity(a.nk, b.nk), 6) AS jw FROM scored s JOIN norm a ON a.rid = s.s1 JOIN norm b ON b.rid = s.p WHERE a.nk <> '' OR b.nk <> ''",
        "er_exclusive": f"{JOINT},\n{BEST}\nSELECT * FROM best",
        "er_pruned": f"{JOINT}\nSELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY s1 ORDER BY prob DESC, p) <= 3 AND prob >= 0.05",
        "er_expected_f": f"""{JOINT},
x AS (SELECT *, row_number() OVER w AS k, sum(prob) OVER w AS run, sum(prob) OVER (PARTITION BY s1) AS total, product(1 - prob) OVER (PARTITION BY s1) AS none FROM scored
  WINDOW w AS (PARTITION BY s1 ORDER BY prob DESC, p ROWS UNBOUNDED PRECEDING)),
y AS (SELECT *, round(1.25 * run / (0.25 * total + k), 9) AS f FROM x), z AS (SELECT *, max(f) OVER (PARTITION BY s1) AS best FROM y),
a AS (SELECT s1, min(k) AS last FROM z WHERE f = best GROUP BY s1)
SELECT z.s1, z.p FROM z JOIN a ON a.s1 = z.s1 WHERE best > round(none, 9) AND k <= last""",
        "er_country_cutoffs": f"{JOINT},\n{BEST},\nkept AS (SELECT b.* FROM best b JOIN norm n ON n.rid = b.s1 WHERE prob >= CASE country WHEN 'en' THEN 0.5 WHEN 'fr' THEN 0.7 ELSE 0.4 END)\n{lists('kept', 'matched_entity_ids')}",
        "er_candidate_lists": f"{JOINT}\n{lists('scored', 'candidate_entity_ids')}",
        "er_flagship": f"{DECIDED}\n{lists('pred', 'matched_entity_ids')}",
        "er_entity_f05": f"{DECIDED},\n{ENTITY}\nSELECT s1, n_pred, n_true, tp, round(f05, 6) AS f05 FROM per_entity",
        "er_summary": f"{DECIDED},\n{ENTITY}\nSELECT {SUMMARY} FROM per_entity",
        "er_summary_by": f"{DECIDED},\n{ENTITY}\nSELECT country, CASE WHEN n_true >= 5 THEN '5+' ELSE n_true::VARCHAR END AS bucket, {SUMMARY} FROM per_entity GROUP BY ALL",
        "er_decision_grid": f"""{JOINT},\n{TRUTH},\n{BEST},\ng AS (SELECT unnest([0.2, 0.4, 0.6, 0.8])::DOUBLE AS t),
j AS (SELECT t, e.rid AS s1, (SELECT count(*) FROM best b WHERE b.s1 = e.rid AND prob >= t) AS n_pred, (SELECT count(*) FROM truth b WHERE b.s1 = e.rid) AS n_true,
  (SELECT count(*) FROM best b JOIN truth x ON b.s1 = x.s1 AND b.p = x.p WHERE b.s1 = e.rid AND prob >= t) AS tp FROM g, (SELECT rid FROM norm WHERE source = 1) e)
SELECT t, {SUMMARY} FROM (SELECT *, {F05} AS f05 FROM j) GROUP BY t""",
        "er_error_types": f"""{DECIDED},
fp AS (SELECT CASE WHEN p.s1 NOT IN (SELECT s1 FROM truth) THEN 'into_singleton' WHEN p.p IN (SELECT p FROM truth) THEN 'owned_elsewhere' ELSE 'distractor' END AS type
  FROM pred p ANTI JOIN truth t ON p.s1 = t.s1 AND p.p = t.p),
fn AS (SELECT CASE WHEN (t.s1, t.p) NOT IN (SELECT (s1, p) FROM scored) THEN 'blocking_miss' WHEN (t.s1, t.p) NOT IN (SELECT (s1, p) FROM best) THEN 'lost_exclusive' ELSE 'below_threshold' END AS type
  FROM truth t ANTI JOIN pred p ON p.s1 = t.s1 AND p.p = t.p)
SELECT 'fp' AS error, type, count(*) AS n FROM fp GROUP BY type UNION ALL SELECT 'fn', type, count(*) FROM fn GROUP BY type""",
        "er_pseudo_labels": f"""{JOINT},
x AS (SELECT *, max(prob) OVER (PARTITION BY p) AS best, row_number() OVER (PARTITION BY p ORDER BY prob DESC, s1) AS r FROM scored),
y AS (SELECT *, coalesce(max(prob) FILTER (r = 2) OVER (PARTITION BY p), 0) AS second FROM x)
SELECT s1, p, CASE WHEN prob >= 0.995 AND prob >= best AND second < 0.5 THEN 1 WHEN prob <= 0.05 OR (prob < best AND best >= 0.9) THEN 0 ELSE -1 END::INT AS pseudo FROM y""",
        "er_shift": """WITH l AS (UNPIVOT (SELECT l_returnflag AS side, l_quantity, l_extendedprice, l_discount, l_tax, l_linenumber::DOUBLE AS l_linenumber FROM lineitem WHERE l_returnflag IN ('A', 'R'))
  ON l_quantity, l_extendedprice, l_discount, l_tax, l_linenumber INTO NAME feature VALUE x)
SELECT feature, round(median(x) FILTER (side = 'R'), 6) AS median_a, round(median(x) FILTER (side = 'A'), 6) AS median_b,
  round((avg(x) FILTER (side = 'A') - avg(x) FILTER (side = 'R')) / (stddev_pop(x) + 1e-9), 6) AS std_shift FROM l GROUP BY feature""",
        "er_change_histogram": f"""WITH {BASE},\n{retrieve("joint")},\n{retrieve("name")},\nc AS (SELECT round(j.score - n.score, 6) AS x FROM r_joint j JOIN r_name n ON j.s1 = n.s1 AND j.p = n.p)
SELECT CASE WHEN x < -0.5 THEN 0 WHEN x < -0.2 THEN 1 WHEN x < -0.05 THEN 2 WHEN x < 0.05 THEN 3 WHEN x < 0.2 THEN 4 WHEN x < 0.5 THEN 5 ELSE 6 END::INT AS bin, count(*) AS n
FROM c WHERE x BETWEEN -1 AND 1 GROUP BY ALL""",
        "er_validation": f"""{JOINT},\nl0 AS ({lists("scored", "ids")}),\nl1 AS (SELECT source1_entity_id AS s, list_filter(string_split(ids, ','), lambda i: i <> '') AS ids FROM l0),
l AS (SELECT s, CASE WHEN s LIKE '%7' THEN list_concat(ids, ids[1:1], [s, 'X9-1']) ELSE ids END AS ids FROM l1), i AS (SELECT s, unnest(ids) AS id FROM l),
x AS (SELECT 'duplicate_row' AS rule, s AS x FROM l GROUP BY s HAVING count(*) > 1 UNION ALL SELECT 'duplicate_in_list', s FROM l WHERE len(ids) <> len(list_distinct(ids))
  UNION ALL SELECT 'source1_in_list', id FROM i WHERE starts_with(id, 'S1-') UNION ALL SELECT 'wrong_prefix', id FROM i WHERE NOT regexp_matches(id, '^S[123]-')
  UNION ALL SELECT 'missing_row', entity_id FROM norm WHERE source = 1 AND entity_id NOT IN (SELECT s FROM l) UNION ALL SELECT 'unexpected_row', s FROM l WHERE s NOT IN (SELECT entity_id FROM norm WHERE source = 1)
  UNION ALL SELECT 'unknown_id', id FROM i WHERE id NOT IN (SELECT entity_id FROM norm))
SELECT r.rule, count(x) AS n, coalesce(array_to_string(list_sort(list(x))[1:5], ','), '') AS examples
FROM (SELECT unnest(['duplicate_row', 'duplicate_in_list', 'source1_in_list', 'wrong_prefix', 'missing_row', 'unexpected_row', 'unknown_id']) AS rule) r LEFT JOIN x ON x.rule = r.rule GROUP BY r.rule""",
    }
    out["er_retrieve_capped"] = f"WITH {BASE},\n{retrieve('joint', 5, 100)}\nSELECT * FROM r_joint"
    return out | {f"er_retrieve_{c}": f"WITH {BASE},\n{retrieve(c)}\nSELECT * FROM r_{c}" for c in (*CHANNELS, "joint_rev")}
