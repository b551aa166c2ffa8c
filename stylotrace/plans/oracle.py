"""The same results in plain SQL over the same tables, for checking the registered queries."""

from __future__ import annotations

from stylotrace.fixed_values import (
    ABLATION_GROUPS,
    BASELINE_EXPERIMENTS,
    DATELINE_PATTERNS,
    FEATURE_HYPOTHESIS,
    GENERATOR_LENGTHS,
    GENERATOR_MODELS,
    GENERATOR_STYLES,
    SURFACE_FEATURES,
    SURFACE_FEATURES_V1,
    SYNTACTIC_FEATURES,
)
from stylotrace.operators import lexicon as lx
from stylotrace.operators.explain import NO_REASON, WORDING
from stylotrace.operators.models import DETECTORS
from stylotrace.operators.syntax import SUMMED_FEATURES
from stylotrace.plans.queries import RUN_NAMES, SCENARIOS, SQL_GROUPS, SQL_RULES, SQL_STABILITY, SQL_SYNTACTIC, STOP_WORDS

ORACLE_SQL: dict[str, str] = {}

BLANKS = (
    "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||' '||chr(133)||chr(160)||chr(5760)"
    "||chr(8192)||chr(8193)||chr(8194)||chr(8195)||chr(8196)||chr(8197)||chr(8198)||chr(8199)||chr(8200)||chr(8201)"
    "||chr(8202)||chr(8232)||chr(8233)||chr(8239)||chr(8287)||chr(12288)"
)
WS = r"\t\n\x0b\x0c\r\x1c-\x1f \x{85}\p{Z}"


def strip(x: str) -> str:
    return f"trim({x}, {BLANKS})"


def ws_words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '[{WS}]+'), lambda w: w <> '')"


def lexical(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]{{2,}}')"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def r6(x: str, name: str) -> str:
    return f"round({x}, 6) AS {name}"


def cols(names, prefix="") -> str:
    return ", ".join(prefix + n for n in names)


DOCS = "docs AS (SELECT doc_id, lang, source, text FROM documents)"
CONV = (
    "conv AS (SELECT conv_id * 1000 + turn AS doc_id, CASE role WHEN 'user' THEN 0 ELSE 1 END AS y, text "
    "FROM conversations WHERE role IN ('user', 'assistant') AND length(text) >= 100)"
)
CONV_EN = "src AS (SELECT doc_id, 'en' AS lang, text FROM conv)"


def ranked(name: str, table: str, keys: str, extra: str = "") -> str:
    by = f"PARTITION BY {keys} " if keys else ""
    return (
        f"{name} AS (SELECT *, row_number() OVER ({by}ORDER BY md5('42:' || doc_id), doc_id) AS rk, "
        f"count(*) OVER ({by.strip()}) AS total {extra} FROM {table})"
    )


SPLIT = ranked("ranked", "conv", "y") + (
    ", split AS (SELECT doc_id, y, text, CASE WHEN rk <= round(total * 0.2) THEN 'test' ELSE 'train' END AS split FROM ranked)"
)


# Corpus preparation ------------------------------------------------------------------------------

_contract = {"doc_id": None, "text": None, "lang": "('en', 'de', 'fr')", "quality": "(0, 1)"}
ORACLE_SQL["corpus_contract"] = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) FILTER (WHERE {c} IS NULL) AS n_null, "
    + (f"count(*) FILTER (WHERE {c} NOT IN {d}) AS n_outside" if d else "0::BIGINT AS n_outside")
    + " FROM documents LEFT JOIN labels USING (doc_id)"
    for c, d in _contract.items()
)
ORACLE_SQL["corpus_profile"] = f"""
WITH t AS (SELECT role = 'assistant' AS is_ai, turn % 2 = 1 AS red, 'turn' || turn AS source,
                  len({ws_words('text')}) AS w FROM conversations WHERE role <> 'system'),
g AS (SELECT is_ai, source, count(*) AS n_rows, count(*) FILTER (WHERE red) AS n_redacted,
             CAST(floor(avg(w)) AS BIGINT) AS mean_words FROM t GROUP BY ALL)
SELECT is_ai, source, n_rows, n_redacted, mean_words,
       CAST(sum(n_rows) OVER (PARTITION BY is_ai) AS BIGINT) AS class_rows,
       round(sum(n_rows) OVER (PARTITION BY is_ai) / sum(n_rows) OVER (), 6) AS class_share FROM g"""

ORACLE_SQL["corpus_totals"] = f"""
WITH t AS (SELECT role = 'assistant' AS is_ai, turn % 2 = 1 AS red, len({ws_words('text')}) AS w FROM conversations WHERE role <> 'system')
SELECT count(*) AS n_rows, count(*) FILTER (WHERE is_ai) AS n_ai, count(*) FILTER (WHERE NOT is_ai) AS n_human,
       count(*) FILTER (WHERE red) AS n_redacted, CAST(coalesce(floor(avg(w)), 0) AS BIGINT) AS mean_words FROM t"""


def cleaned(x: str) -> str:
    out = f"replace(replace(replace({x}, chr(10), ' '), chr(13), ' '), chr(160), ' ')"
    for p in DATELINE_PATTERNS:
        out = f"regexp_replace({out}, {q('(?i)' + p)}, '')"
    return out


def clean_cte(table: str, keep: str) -> str:
    return (
        f"c0 AS (SELECT {keep}, {cleaned('text')} AS t FROM {table}), "
        f"clean AS (SELECT {keep}, coalesce({strip('''CASE WHEN regexp_matches(t, '[А-ЯЁA-Z]') THEN regexp_extract(t, '(?s)[А-ЯЁA-Z].*') ELSE t END''')}, '') AS text FROM c0)"
    )


ORACLE_SQL["corpus_clean"] = f"WITH {clean_cte('documents', 'doc_id')} SELECT doc_id, text FROM clean"
ORACLE_SQL["corpus_dedupe"] = """
SELECT doc_id, lang, source, n_chars FROM documents WHERE text IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1"""
ORACLE_SQL["corpus_lengths"] = f"""
WITH {clean_cte('documents', 'doc_id')}
SELECT doc_id, len({ws_words('text')}) AS length_words, length(text) AS length_chars FROM clean WHERE length(text) >= 100"""
ORACLE_SQL["corpus_defaults"] = """
SELECT doc_id, CASE WHEN source IN ('src3', 'src4', 'src5') THEN 'General' ELSE source END AS topic,
       0.5::DOUBLE AS temperature, 0.9::DOUBLE AS top_p FROM documents"""
ORACLE_SQL["corpus_union"] = """
SELECT conv_id * 1000 + turn AS doc_id, text, role = 'assistant' AS is_ai, role = 'assistant' AND turn > 1 AS is_redacted,
       CASE role WHEN 'user' THEN 'human_archive' ELSE 'assistant' END AS source,
       CASE WHEN role = 'user' AND turn > 1 THEN 'chat' ELSE 'General' END AS topic,
       CASE role WHEN 'user' THEN 0.0::DOUBLE ELSE 0.7::DOUBLE END AS temperature,
       CASE role WHEN 'user' THEN 0.0::DOUBLE ELSE 0.9::DOUBLE END AS top_p
FROM conversations WHERE role IN ('user', 'assistant')"""
ORACLE_SQL["corpus_build"] = f"""
WITH t AS (SELECT conv_id * 1000 + turn AS doc_id, role = 'assistant' AS is_ai, text FROM conversations WHERE role IN ('user', 'assistant')),
d AS (SELECT * FROM t WHERE is_ai OR text IS NOT NULL
      QUALIFY is_ai OR row_number() OVER (PARTITION BY is_ai, text ORDER BY doc_id) = 1),
{clean_cte('d', 'doc_id, is_ai')},
k AS (SELECT *, row_number() OVER (PARTITION BY is_ai ORDER BY md5('42:' || doc_id), doc_id) AS rk FROM clean),
s AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS id FROM k WHERE rk <= 5000)
SELECT id, text, is_ai, CASE WHEN is_ai THEN 'assistant' ELSE 'human_archive' END AS source,
       CASE WHEN is_ai THEN 'chat' ELSE 'General' END AS topic,
       CASE WHEN is_ai THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END AS temperature,
       CASE WHEN is_ai THEN 0.9::DOUBLE ELSE 0.0::DOUBLE END AS top_p,
       len({ws_words('text')}) AS length_words, length(text) AS length_chars FROM s"""
ORACLE_SQL["corpus_build_capped"] = ORACLE_SQL["corpus_build"].replace("rk <= 5000", "rk <= 20")
_share = (
    "CASE WHEN len(w) = 0 THEN 0.0::DOUBLE ELSE len(list_filter(w, lambda x: regexp_matches(x, '{0}'))) * 100.0::DOUBLE / len(w) END"
)
ORACLE_SQL["script_share"] = f"""
WITH t AS (SELECT doc_id, {ws_words('text')} AS w FROM documents)
SELECT doc_id, {r6(_share.format('[A-Za-z]'), 'latin_pct')}, {r6(_share.format('[а-яА-ЯёЁ]'), 'cyrillic_pct')} FROM t"""


def gate_cte(src: str, keep: str) -> str:
    return (
        f"w AS (SELECT {keep}, text, {ws_words('text')} AS w FROM {src}), "
        f"gate AS (SELECT *, CASE WHEN len(w) < 100 THEN 'short' WHEN {_share.format('[A-Za-z]')} < 50 THEN 'script' ELSE 'ok' END AS reason FROM w)"
    )


ORACLE_SQL["quality_gate"] = f"""
WITH {gate_cte('documents', 'lang')}
SELECT lang, reason, reason = 'ok' AS accepted, count(*) AS n_texts FROM gate GROUP BY ALL"""


def titled(keep: str) -> str:
    title = "CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, 1, strpos(text, chr(10)) - 1) ELSE text END"
    body = "CASE WHEN strpos(t, chr(10)) > 0 THEN substr(t, strpos(t, chr(10)) + 1) ELSE t END"
    return (
        f"t0 AS (SELECT *, {title} AS title, {strip('text')} AS t FROM documents), "
        f"titled AS (SELECT {keep}, CASE WHEN starts_with(t, title) OR starts_with(t, '«' || title || '»') "
        f"THEN {strip(body)} ELSE t END AS text FROM t0)"
    )


ORACLE_SQL["title_strip"] = f"WITH {titled('doc_id')} SELECT doc_id, text FROM titled"


def _uniform(salt: str) -> str:
    return f"(('0x' || substr(md5('42:' || request_id || ':{salt}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _pick(options, salt: str) -> str:
    listed = ", ".join(q(o) for o in options)
    return f"[{listed}][CAST(floor({_uniform(salt)} * {len(options)}) AS BIGINT) + 1]"


def _model(i: int, otherwise: str) -> str:
    arms = " ".join(
        f"WHEN {k} THEN {q(m[i]) if isinstance(m[i], str) else f'{m[i]}::DOUBLE'}"
        for k, m in enumerate(GENERATOR_MODELS)
        if m[i] is not None
    )
    return f"CASE (request_id - 1) % {len(GENERATOR_MODELS)} {arms} ELSE {otherwise} END"


ORACLE_SQL["generation_plan"] = f"""
WITH titles AS (SELECT row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS pick,
    CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, 1, strpos(text, chr(10)) - 1) ELSE text END AS title, source AS topic FROM documents),
ids AS (SELECT unnest(range(1, (SELECT count(*) FROM documents) + 1)) AS request_id),
req AS (SELECT request_id, {_model(0, 'NULL')} AS model_id, {_model(1, 'NULL')} AS model_label,
    {_model(2, f"round({_uniform('t')} * 0.6::DOUBLE + 0.3::DOUBLE, 2)")} AS temperature,
    {_model(3, f"round({_uniform('p')} * 0.2::DOUBLE + 0.8::DOUBLE, 2)")} AS top_p,
    {_pick(GENERATOR_LENGTHS, 'l')} AS target_length, {_pick(GENERATOR_STYLES, 's')} AS style,
    CAST(floor({_uniform('d')} * (SELECT count(*) FROM documents)) AS BIGINT) AS pick FROM ids)
SELECT request_id, model_id, model_label, temperature, top_p, target_length, style, title, topic FROM req JOIN titles USING (pick)"""
ORACLE_SQL["resume_new_rows"] = """
WITH fresh AS (SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))
SELECT doc_id, lang, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) + (SELECT coalesce(max(doc_id), 0) FROM labels) AS new_id FROM fresh"""

# Samples and splits ------------------------------------------------------------------------------

ORACLE_SQL["sample_per_class"] = f"WITH {ranked('k', 'documents', 'lang')} SELECT doc_id, lang FROM k WHERE rk <= 150"
ORACLE_SQL["sample_balanced"] = f"""
WITH {CONV}, {ranked('k', 'conv', 'y')}
SELECT doc_id, y FROM k WHERE rk <= least(1000, (SELECT min(total) FROM k))"""
ORACLE_SQL["sample_capped"] = ORACLE_SQL["sample_balanced"].replace("least(1000", "least(10")
ORACLE_SQL["corpus_shuffle"] = f"WITH {CONV}, {ranked('k', 'conv', '')} SELECT rk - 1 AS id, doc_id, y FROM k"
ORACLE_SQL["split_stratified"] = f"WITH {CONV}, {SPLIT} SELECT doc_id, y, split FROM split"
ORACLE_SQL["kfold_stratified"] = f"WITH {CONV}, {ranked('k', 'conv', 'y')} SELECT doc_id, y, (rk - 1) % 5 AS fold FROM k"
ORACLE_SQL["split_disjoint"] = f"""
WITH {ranked('k', 'documents', 'lang')}
SELECT doc_id, lang FROM k WHERE rk <= round(total * 0.2)
AND text NOT IN (SELECT text FROM k WHERE rk > round(total * 0.2))"""
ORACLE_SQL["class_weights"] = f"""
WITH {CONV} SELECT y, count(*) AS n_class, round((SELECT count(*) FROM conv) / (2.0::DOUBLE * count(*)), 6) AS weight FROM conv GROUP BY y"""

# Sources -----------------------------------------------------------------------------------------

ORACLE_SQL["qa_long"] = f"""
SELECT conv_id || '/' || turn AS question, {strip('text')} AS text, CASE role WHEN 'user' THEN 0 ELSE 1 END AS is_ai
FROM conversations WHERE role IN ('user', 'assistant') AND length(text) >= 100"""
ORACLE_SQL["roundtrip_csv"] = """
SELECT doc_id AS id, text, lang = 'en' AS is_ai, false AS is_redacted, source, lang AS topic, 0.7::DOUBLE AS temperature,
       0.9::DOUBLE AS top_p, 0::BIGINT AS length_words, n_chars AS length_chars FROM documents"""


# Surface features --------------------------------------------------------------------------------


def surface_cte(src: str, name: str = "surf", keep: str = "") -> str:
    n = "greatest(len(w), 1)"
    count = lambda cls: f"length(regexp_replace(text, '[^{cls}]', '', 'g'))"
    sents = "greatest(len(regexp_extract_all(text, '[.!?]+')), 1)"
    exprs = {
        "comma_density": f"{count(',')} * 1000.0::DOUBLE / length(text)",
        "dash_density": f"{count('—-')} * 1000.0::DOUBLE / length(text)",
        "quote_density": f"{count(chr(34) + '«»')} * 1000.0::DOUBLE / length(text)",
        "excl_density": f"{count('!')} * 1000.0::DOUBLE / length(text)",
        "punct_intensity": f"{count('.,!?;:—()-')} * 1000.0::DOUBLE / length(text)",
        "avg_word_len": f"list_sum(list_transform(w, lambda x: length(x)))::DOUBLE / {n}",
        "avg_sent_len": f"{n}::DOUBLE / {sents}",
        "caps_ratio": rf"{count(chr(92) + 'p{Lu}')}::DOUBLE / length(text)",
        "digit_ratio": rf"{count(chr(92) + 'p{Nd}')}::DOUBLE / length(text)",
        "unique_word_ratio": f"len(list_distinct(list_transform(w, lambda x: lower(x))))::DOUBLE / {n}",
    }
    listed = ", ".join(f"CASE WHEN len(w) = 0 THEN 0.0::DOUBLE ELSE {e} END AS {f}" for f, e in exprs.items())
    return (
        f"{name}_w AS (SELECT doc_id{keep}, text, {ws_words('text')} AS w FROM {src}), "
        f"{name} AS (SELECT doc_id{keep}, text, w, {listed} FROM {name}_w)"
    )


_rounded_surface = ", ".join(r6(f, f) for f in SURFACE_FEATURES)
ORACLE_SQL["surface_features"] = f"WITH {surface_cte('documents')} SELECT doc_id, {_rounded_surface} FROM surf"
ORACLE_SQL["feature_store"] = f"WITH {CONV}, {surface_cte('conv')} SELECT doc_id, {_rounded_surface} FROM surf"
_v1 = {f: f for f in SURFACE_FEATURES_V1} | {
    "avg_word_len": "CASE WHEN len(w) = 0 THEN 0.0::DOUBLE ELSE length(text)::DOUBLE / len(w) END",
}
ORACLE_SQL["surface_features_v1"] = (
    f"WITH {surface_cte('documents')} SELECT doc_id, " + ", ".join(r6(e, f) for f, e in _v1.items()) + " FROM surf"
)
ORACLE_SQL["features_sanitised"] = """
WITH t AS (SELECT *, length(regexp_replace(text, '[^0-9]', '', 'g')) AS d FROM documents)
SELECT doc_id, round(CASE WHEN d = 0 THEN 0 ELSE n_chars::DOUBLE / d END, 6) AS chars_per_digit,
       CASE WHEN lang IN ('de', 'fr') THEN 0.0::DOUBLE ELSE n_chars::DOUBLE END AS size FROM t"""

# Tokens ------------------------------------------------------------------------------------------

_unnested = "unnest({0}) AS {1}, generate_subscripts({0}, 1) - 1 AS pos"
ORACLE_SQL["words"] = f"""
WITH t AS (SELECT {_unnested.format(ws_words('text'), 'word')} FROM documents)
SELECT word, count(*) AS n, CAST(sum(pos) AS BIGINT) AS pos_sum FROM t GROUP BY word"""
ORACLE_SQL["lexical_tokens"] = f"""
WITH t AS (SELECT {_unnested.format(lexical('text'), 'token')} FROM documents)
SELECT token, count(*) AS n, CAST(sum(pos) AS BIGINT) AS pos_sum FROM t GROUP BY token"""


def _rules(rules, otherwise: str) -> str:
    arms = " ".join(f"WHEN lang = '{lang}' AND regexp_matches(lower, {q(p)}) THEN '{v}'" for lang, v, p in rules)
    return f"CASE {arms} ELSE {otherwise} END"


def tokens_cte(src: str, shortest: int = 0) -> str:
    """Token relation ``tok`` of table ``src(doc_id, lang, text)``; texts below ``shortest`` are left out."""
    pattern = rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{WS}]"
    found = f"regexp_extract_all(text, '{pattern}')"
    words = ", ".join(f"({q(a)}, {q(b)}, {q(c)}, {str(d).lower()})" for a, b, c, d in lx.lexicon_rows())
    active = " OR ".join(f"(lang = '{k}' AND regexp_matches(lower, {q(p)}))" for k, p in lx.ACTIVE_PARTICIPLE.items())
    content = ", ".join(q(p) for p in lx.CONTENT_POS)
    s = "PARTITION BY doc_id, sent_id ORDER BY pos"
    return rf"""
lexi(lang, lower, closed, is_be) AS (VALUES {words}),
k0 AS (SELECT doc_id, lang, unnest({found}) AS text, generate_subscripts({found}, 1) - 1 AS pos FROM {src} WHERE length({strip('text')}) >= {shortest}),
k1 AS (SELECT *, lower(text) AS lower, text IN ('.', '!', '?') AS ends,
       coalesce(lag(text) OVER (PARTITION BY doc_id ORDER BY pos) IN ('.', '!', '?'), false) AS after_end FROM k0),
k2 AS (SELECT k1.*, CAST(sum(CASE WHEN NOT ends AND after_end THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS sent_id,
       regexp_matches(text, '^\p{{P}}$') AND text <> '_' AS is_punct FROM k1),
k3 AS (SELECT k2.*, closed, coalesce(is_be, false) AS is_be FROM k2 LEFT JOIN lexi USING (lang, lower)),
k4 AS (SELECT *, CASE WHEN is_punct THEN 'PUNCT' WHEN closed IS NOT NULL THEN closed WHEN regexp_matches(lower, '^\p{{N}}+$') THEN 'NUM'
       WHEN NOT regexp_matches(lower, '[\p{{L}}\p{{N}}_]') THEN 'SYM' ELSE {_rules(lx.SUFFIX_RULES, "'NOUN'")} END AS upos FROM k3),
k5 AS (SELECT *, CASE WHEN upos = 'VERB' THEN {_rules(lx.VERB_FORM_RULES, 'NULL')} END AS verb_form, upos IN ({content}) AS content,
       coalesce(lag(text) OVER ({s}) = ',', false) AS after_comma,
       coalesce(lag(is_be, 1) OVER ({s}), false) OR coalesce(lag(is_be, 2) OVER ({s}), false) AS be_near,
       coalesce(min(pos) FILTER (WHERE upos = 'VERB') OVER (PARTITION BY doc_id, sent_id),
                min(pos) FILTER (WHERE upos IN ({content})) OVER (PARTITION BY doc_id, sent_id),
                min(pos) OVER (PARTITION BY doc_id, sent_id)) AS root FROM k4),
k6 AS (SELECT *, max(CASE WHEN content THEN pos END) OVER ({s} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_c,
       min(CASE WHEN content THEN pos END) OVER ({s} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_c,
       CAST(count(*) FILTER (WHERE content) OVER ({s}) AS BIGINT) AS seen FROM k5),
k7 AS (SELECT *, content AND (pos = root OR prev_c IS NULL OR after_comma) AS restarts FROM k6),
k8 AS (SELECT *, CASE WHEN content THEN seen - last_value(CASE WHEN restarts THEN seen - CASE WHEN pos = root THEN 0 ELSE 1 END END IGNORE NULLS) OVER ({s}) END AS c_depth FROM k7),
tok AS (SELECT a.doc_id, a.sent_id, a.pos, a.text, a.lower AS lemma, a.upos, a.is_punct, a.verb_form,
       CASE WHEN a.verb_form = 'Part' AND a.be_near AND NOT ({active.replace('lang =', 'a.lang =').replace('lower,', 'a.lower,')}) THEN 'Pass' END AS voice,
       CASE WHEN a.pos = a.root OR a.is_punct OR a.restarts THEN a.root WHEN NOT a.content THEN coalesce(a.next_c, a.root) ELSE a.prev_c END AS head,
       CASE WHEN a.pos = a.root THEN 0 WHEN a.is_punct THEN 1 WHEN NOT a.content THEN coalesce(b.c_depth + 1, 1) ELSE a.c_depth END AS depth
       FROM k8 a LEFT JOIN k8 b ON a.doc_id = b.doc_id AND a.next_c = b.pos)"""


ORACLE_SQL["token_relation"] = f"""
WITH {tokens_cte('documents')}
SELECT doc_id, upos, is_punct, coalesce(verb_form, '-') AS verb_form, count(*) AS n, count(*) FILTER (WHERE voice = 'Pass') AS n_passive,
       CAST(sum(pos) AS BIGINT) AS pos_sum, CAST(sum(head) AS BIGINT) AS head_sum, CAST(sum(depth) AS BIGINT) AS depth_sum,
       CAST(sum(sent_id) AS BIGINT) AS sent_sum, count(*) FILTER (WHERE depth = 0) AS n_roots, CAST(sum(length(text)) AS BIGINT) AS text_chars,
       CAST(sum(length(lemma)) AS BIGINT) AS lemma_chars
FROM tok GROUP BY ALL"""
ORACLE_SQL["sentences"] = f"""
WITH {tokens_cte('documents')} SELECT doc_id, sent_id, count(*) AS n_tokens, min(pos) AS first_pos FROM k2 GROUP BY ALL"""
ORACLE_SQL["dependency_depth"] = f"""
WITH {tokens_cte('documents')}
SELECT doc_id, sent_id, max(depth) AS max_depth, CAST(sum(depth) AS BIGINT) AS depth_sum FROM tok GROUP BY ALL"""


def syntactic_cte(src: str, name: str = "syn") -> str:
    """Features ``syn(doc_id, ...)`` of ``src(doc_id, lang, text)``, without the compression feature."""
    entropy = "CASE WHEN sum(n) > 0 THEN log2(sum(n)) - sum(n * log2(n)) / sum(n) END"
    value = lambda f: f"round({f}, 9) + 0.0::DOUBLE" if f in SUMMED_FEATURES else f
    zero = ", ".join(f"coalesce({value(f)}, 0.0::DOUBLE) AS {f}" for f in SQL_SYNTACTIC)
    return f"""{tokens_cte(src, 20)},
f_sent AS (SELECT doc_id, avg(c) AS avg_sent_len, stddev_pop(c) AS burstiness, avg(d) AS avg_dep_depth FROM
    (SELECT doc_id, sent_id, count(*) FILTER (WHERE NOT is_punct) AS c, max(depth) AS d FROM tok GROUP BY ALL) GROUP BY doc_id),
f_tok AS (SELECT doc_id, count(*) FILTER (WHERE is_punct)::DOUBLE / count(*) AS punct_density,
    count(*) FILTER (WHERE upos = 'NOUN') / (count(*) FILTER (WHERE upos = 'VERB') + 1e-9::DOUBLE) AS nv_ratio,
    count(*) FILTER (WHERE verb_form IN ('Part', 'Conv'))::DOUBLE / count(*) AS complexity_ratio,
    CASE WHEN count(*) FILTER (WHERE upos IN ('VERB', 'AUX')) = 0 THEN 0.0::DOUBLE ELSE
      count(*) FILTER (WHERE voice = 'Pass')::DOUBLE / count(*) FILTER (WHERE upos IN ('VERB', 'AUX')) END AS passive_ratio,
    count(*)::DOUBLE AS total_tokens FROM tok GROUP BY doc_id),
f_mark AS (SELECT doc_id, {entropy} AS punct_entropy FROM (SELECT doc_id, text, count(*) AS n FROM tok WHERE is_punct GROUP BY ALL) GROUP BY doc_id),
f_tag AS (SELECT doc_id, {entropy} AS pos_entropy FROM (SELECT doc_id, upos, count(*) AS n FROM tok WHERE NOT is_punct GROUP BY ALL) GROUP BY doc_id),
f_lem AS (SELECT doc_id, count(*)::DOUBLE / sum(n) AS ttr, count(*) FILTER (WHERE n = 1)::DOUBLE / sum(n) AS hlr
    FROM (SELECT doc_id, lemma, count(*) AS n FROM tok WHERE NOT is_punct GROUP BY ALL) GROUP BY doc_id),
f_gap AS (SELECT doc_id, stddev_pop(g) / avg(g) AS comma_cv FROM
    (SELECT doc_id, pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM tok WHERE text = ',') GROUP BY doc_id),
f_tri AS (SELECT doc_id, count(DISTINCT t)::DOUBLE / count(*) AS unique_trigrams_per_tok FROM
    (SELECT doc_id, lag(upos, 2) OVER (PARTITION BY doc_id ORDER BY pos) || ' ' || lag(upos, 1) OVER (PARTITION BY doc_id ORDER BY pos) || ' ' || upos AS t
     FROM tok WHERE NOT is_punct) GROUP BY doc_id),
{name} AS (SELECT {src}.doc_id, {zero} FROM {src} LEFT JOIN f_sent USING (doc_id) LEFT JOIN f_tok USING (doc_id) LEFT JOIN f_mark USING (doc_id)
    LEFT JOIN f_tag USING (doc_id) LEFT JOIN f_lem USING (doc_id) LEFT JOIN f_gap USING (doc_id) LEFT JOIN f_tri USING (doc_id))"""


ORACLE_SQL["syntactic_features"] = (
    f"WITH {syntactic_cte('documents')} SELECT doc_id, {cols(SQL_SYNTACTIC)} FROM syn"
)

# TF-IDF ------------------------------------------------------------------------------------------


def grams(src: str, stop, name: str = "gr") -> str:
    stops = ", ".join(q(s) for s in stop) or "''"
    return (
        f"{name}_t AS (SELECT doc_id, list_filter({lexical('text')}, lambda w: w NOT IN ({stops})) AS t FROM {src}), "
        f"{name}_l AS (SELECT doc_id, list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS g FROM {name}_t), "
        f"{name} AS (SELECT doc_id, {_unnested.format('g', 'term')} FROM {name}_l)"
    )


def vocab(src: str, stop, min_df: int, limit: int) -> str:
    return (
        f"{grams(src, stop, 'vg')}, voc AS (SELECT term, count(DISTINCT doc_id) AS df, count(*) AS total FROM vg GROUP BY term "
        f"HAVING count(DISTINCT doc_id) >= {min_df} ORDER BY total DESC, term LIMIT {limit})"
    )


def tfidf(fit: str, apply: str, preset: str) -> str:
    from stylotrace.fixed_values import TFIDF_PRESETS

    p = TFIDF_PRESETS[preset]
    tf = "(1 + ln(tf))" if p["sublinear"] else "tf::DOUBLE"
    return f"""
WITH {CONV}, {SPLIT}, fit AS (SELECT * FROM split WHERE {fit}), app AS (SELECT * FROM split WHERE {apply}),
{vocab('fit', p['stop_words'], p['min_df'], p['max_features'])}, {grams('app', p['stop_words'], 'ag')},
tf AS (SELECT doc_id, term, count(*) AS tf FROM ag GROUP BY ALL),
w AS (SELECT doc_id, term, tf, {tf} * (ln((1 + (SELECT count(*) FROM fit))::DOUBLE / (1 + df)) + 1) AS w FROM tf JOIN voc USING (term))
SELECT doc_id, term, tf, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w"""


ORACLE_SQL["ngrams"] = f"""
WITH {CONV}, {grams('conv', STOP_WORDS)}
SELECT term, count(*) AS n, CAST(sum(pos) AS BIGINT) AS pos_sum FROM gr GROUP BY term"""
ORACLE_SQL["vocabulary"] = f"WITH {CONV}, {vocab('conv', STOP_WORDS, 3, 3000)} SELECT * FROM voc"
ORACLE_SQL["vocabulary_notebook"] = f"WITH {CONV}, {vocab('conv', [], 5, 2000)} SELECT * FROM voc"
ORACLE_SQL["tfidf"] = tfidf("split = 'train'", "split = 'train'", "library")
ORACLE_SQL["tfidf_transform"] = tfidf("split = 'train'", "split = 'test'", "library")
ORACLE_SQL["tfidf_notebook"] = tfidf("split = 'train'", "split = 'test'", "notebook")

# Statistics --------------------------------------------------------------------------------------

FEATS = f"{CONV}, {CONV_EN}, {syntactic_cte('src')}, feats AS (SELECT conv.y, syn.* FROM syn JOIN conv USING (doc_id))"


def long_cte(table: str = "feats", features=SQL_SYNTACTIC, keep: str = "doc_id, y", name: str = "lng") -> str:
    return f"{name} AS (SELECT {keep}, feature, value FROM (FROM {table} UNPIVOT (value FOR feature IN ({cols(features)}))))"


ORACLE_SQL["feature_describe"] = f"""
WITH {FEATS}, {long_cte()}
SELECT feature, count(*) AS n_rows, round(avg(value), 3) AS mean, round(stddev_samp(value), 3) AS std, round(min(value), 3) AS min,
       round(quantile_cont(value, 0.25), 3) AS q25, round(quantile_cont(value, 0.5), 3) AS q50, round(quantile_cont(value, 0.75), 3) AS q75,
       round(max(value), 3) AS max FROM lng GROUP BY feature"""
ORACLE_SQL["running_counts"] = """
WITH c AS (SELECT CASE WHEN lang <> 'es' THEN lang END AS lang, n_chars, count(*) AS n FROM documents GROUP BY ALL)
SELECT lang, n_chars, n, CAST(sum(n) OVER w AS BIGINT) AS cum_n, lead(n) OVER w AS next_n FROM c WINDOW w AS (PARTITION BY lang ORDER BY n_chars)"""
ORACLE_SQL["class_means"] = f"WITH {FEATS}, {long_cte()} SELECT y, feature, round(avg(value), 4) AS mean FROM lng GROUP BY ALL"


def mwu_cte(n_features: int) -> str:
    # The normal tail by Simpson's rule on 4,000 intervals.
    return f"""
ranks AS (SELECT feature, y, value, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0::DOUBLE AS r FROM lng),
ties AS (SELECT feature, sum(t * t * t - t)::DOUBLE AS ties FROM (SELECT feature, value, count(*) AS t FROM lng GROUP BY ALL) GROUP BY feature),
us AS (SELECT feature, count(*) FILTER (WHERE y = 0)::DOUBLE AS n1, count(*) FILTER (WHERE y = 1)::DOUBLE AS n2, sum(r) FILTER (WHERE y = 0) AS r1,
       avg(value) FILTER (WHERE y = 0) AS mh, avg(value) FILTER (WHERE y = 1) AS ma FROM ranks GROUP BY feature),
u AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u FROM us JOIN ties USING (feature)),
sg AS (SELECT *, sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS sigma FROM u),
z AS (SELECT *, CASE WHEN sigma > 0 THEN (greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sigma ELSE -9 END AS z FROM sg),
tail AS (SELECT feature, sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-pow(z + i * 0.004::DOUBLE, 2) / 2)) * 0.004::DOUBLE / 3 / sqrt(2 * pi()) * 2 AS p
         FROM z, range(0, 4001) t(i) GROUP BY feature),
mwu AS (SELECT feature, round(mh, 4) AS mean_human, round(ma, 4) AS mean_ai, round(u, 1) AS u, least(p, 1.0::DOUBLE) AS p_value, 
        round(abs(1 - 2 * u / (n1 * n2)), 3) AS effect, p < 0.05 / {n_features} AS significant FROM z JOIN tail USING (feature))"""


_band = "CASE WHEN effect >= 0.5 THEN 'large' WHEN effect >= 0.3 THEN 'medium' WHEN effect >= 0.1 THEN 'small' ELSE 'none' END AS band"
_mwu_out = "feature, mean_human, mean_ai, u, round(p_value, 6) AS p_value, effect, significant"
_n = len(SQL_SYNTACTIC)
ORACLE_SQL["mann_whitney"] = f"WITH {FEATS}, {long_cte()}, {mwu_cte(len(SYNTACTIC_FEATURES))} SELECT {_mwu_out} FROM mwu"
ORACLE_SQL["feature_ranking"] = (
    f"WITH {FEATS}, {long_cte()}, {mwu_cte(len(SYNTACTIC_FEATURES))} SELECT {_mwu_out}, {_band} FROM mwu ORDER BY effect DESC, feature LIMIT 8"
)
ORACLE_SQL["surface_ranking"] = (
    f"WITH {CONV}, {surface_cte('conv', keep=', y')}, {long_cte('surf', SURFACE_FEATURES)}, {mwu_cte(10)} SELECT {_mwu_out}, {_band} FROM mwu"
)
ORACLE_SQL["significant_features"] = f"""
WITH {FEATS}, {long_cte()}, {mwu_cte(len(SYNTACTIC_FEATURES))} SELECT count(*) FILTER (WHERE significant) AS n_significant, count(*) AS n_features FROM mwu"""
_order = ", ".join(f"({i}, {q(f)})" for i, f in enumerate(SQL_SYNTACTIC))
ORACLE_SQL["spearman"] = f"""
WITH {FEATS}, {long_cte()}, names(i, feature) AS (VALUES {_order}),
rk AS (SELECT doc_id, i, feature, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0::DOUBLE AS r FROM lng JOIN names USING (feature))
SELECT a.feature AS feature_a, b.feature AS feature_b, round(corr(a.r, b.r), 6) AS rho FROM rk a JOIN rk b ON a.doc_id = b.doc_id AND a.i > b.i GROUP BY ALL"""
_box = (
    "count(*) AS n_rows, round(min(value), 6) AS min, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50, "
    "round(quantile_cont(value, 0.75), 6) AS q75, round(max(value), 6) AS max"
)
ORACLE_SQL["box_summary"] = f"WITH {FEATS}, {long_cte()} SELECT y, feature, {_box} FROM lng GROUP BY ALL"

# Closed-form scorer ------------------------------------------------------------------------------


def discriminant(feats: str, features, keep: str, tag: str = "", train: str = "split = 'train'", test: str = "split = 'test'") -> str:
    """``scored{tag}(keep, score, p)`` of the test rows of ``feats`` and parameters ``par{tag}``."""
    slope = "CASE WHEN v > 0 THEN (m1 - m0) / v ELSE 0 END"
    return f"""
dl{tag} AS (FROM {feats} UNPIVOT (value FOR feature IN ({cols(features)}))),
par{tag} AS (SELECT feature, m0, m1, v, {slope} AS slope, (m0 + m1) / 2 AS mid, (n0 * m0 + n1 * m1) / (n0 + n1) AS mean,
    CASE WHEN v > 0 THEN abs(m1 - m0) / sqrt(v) ELSE 0 END AS importance FROM (
    SELECT *, (n0 * v0 + n1 * v1) / (n0 + n1) AS v FROM (
    SELECT feature, avg(value) FILTER (WHERE y = 0) AS m0, avg(value) FILTER (WHERE y = 1) AS m1,
      var_pop(value) FILTER (WHERE y = 0) AS v0, var_pop(value) FILTER (WHERE y = 1) AS v1,
      count(*) FILTER (WHERE y = 0) AS n0, count(*) FILTER (WHERE y = 1) AS n1 FROM dl{tag} WHERE {train} GROUP BY feature))),
con{tag} AS (SELECT {keep}, feature, value, (value - mid) * slope AS c FROM dl{tag} JOIN par{tag} USING (feature) WHERE {test}),
scored{tag} AS (SELECT *, round(1 / (1 + exp(-score)), 9) AS p FROM (SELECT {keep}, round(sum(c), 9) AS score FROM con{tag} GROUP BY {keep}))"""


def metrics(pred: str, keys: str = "", name: str = "met") -> str:
    """``met(keys, accuracy, ...)`` unrounded, of a table with y and p."""
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys} " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""
{name}_c AS (SELECT {k}p AS score, count(*) FILTER (WHERE y = 1)::DOUBLE AS pos, count(*) FILTER (WHERE y = 0)::DOUBLE AS neg FROM {pred} GROUP BY {k}p),
{name}_r AS (SELECT *, sum(pos) OVER ({part}ORDER BY score DESC) AS tp, sum(neg) OVER ({part}ORDER BY score DESC) AS fp FROM {name}_c),
{name}_s AS (SELECT {k}sum(pos) AS np, sum(neg) AS nn, coalesce(sum(pos) FILTER (WHERE score >= 0.5), 0) AS tp, coalesce(sum(neg) FILTER (WHERE score >= 0.5), 0) AS fp,
   sum(neg * (tp - pos / 2)) AS pairs, sum(pos * tp / (tp + fp)) AS steps FROM {name}_r {group}),
{name} AS (SELECT {k}(tp + nn - fp) / (np + nn) AS accuracy, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision,
   CASE WHEN np > 0 THEN tp / np ELSE 0 END AS recall, CASE WHEN tp + fp + np > 0 THEN 2 * tp / (tp + fp + np) ELSE 0 END AS f1,
   CASE WHEN np * nn > 0 THEN pairs / (np * nn) ELSE 0 END AS auc_roc, CASE WHEN np > 0 THEN steps / np ELSE 0 END AS ap, CAST(np + nn AS BIGINT) AS n_rows FROM {name}_s)"""


SIX = ["accuracy", "precision", "recall", "f1", "auc_roc", "ap"]
_five = ", ".join(f"round({m}, 5) AS {m}" for m in SIX)
SURF_SCORED = f"{CONV}, {SPLIT}, {surface_cte('split', keep=', y, split')}, " + discriminant("surf", SURFACE_FEATURES, "doc_id, y, text")

ORACLE_SQL["score_histogram"] = f"""
WITH {SURF_SCORED}, sp AS (SELECT y, min(p) AS lo, max(p) AS hi, count(*) AS total FROM scored GROUP BY y),
b AS (SELECT y, CAST(least(floor((p - lo) / ((hi - lo) / 40)), 39) AS BIGINT) AS bin, count(*) AS n FROM scored JOIN sp USING (y) GROUP BY ALL),
g AS (SELECT *, unnest(range(0, 40)) AS bin FROM sp)
SELECT y, bin, round(lo + bin * ((hi - lo) / 40), 6) AS lower, round(lo + (bin + 1) * ((hi - lo) / 40), 6) AS upper, coalesce(n, 0) AS n,
       round(coalesce(n, 0) / (total * ((hi - lo) / 40)), 6) AS density FROM g LEFT JOIN b USING (y, bin)"""
ORACLE_SQL["score_kde"] = f"""
WITH {SURF_SCORED}, sh AS (SELECT y, count(*) AS n, stddev_samp(p) * pow(count(*), -0.2::DOUBLE) AS h FROM scored GROUP BY y)
SELECT y, point, round(point / 299.0::DOUBLE, 6) AS x, round(sum(exp(-0.5 * pow((point / 299.0::DOUBLE - p) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 6) AS density
FROM scored JOIN sh USING (y), range(0, 300) t(point) GROUP BY y, point"""
ORACLE_SQL["confusion"] = f"""
WITH {SURF_SCORED}, g AS (SELECT * FROM (VALUES (0), (1)) a(y), (VALUES (0), (1)) b(y_pred)),
c AS (SELECT y, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS y_pred, count(*) AS n FROM scored GROUP BY ALL)
SELECT CAST(y AS BIGINT) AS y, CAST(y_pred AS BIGINT) AS y_pred, coalesce(n, 0) AS n, round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY y), 6) AS share FROM g LEFT JOIN c USING (y, y_pred)"""
ORACLE_SQL["class_report"] = f"""
WITH {SURF_SCORED}, f AS (SELECT doc_id, 1 - y AS y, 1 - p AS p FROM scored), lab AS (SELECT y, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS h FROM scored),
k AS (SELECT c, count(*) FILTER (WHERE y = c AND h = c)::DOUBLE AS tp, count(*) FILTER (WHERE h = c) AS hc, count(*) FILTER (WHERE y = c) AS support FROM lab, (VALUES (0), (1)) v(c) GROUP BY c),
m AS (SELECT CASE c WHEN 0 THEN 'human' ELSE 'ai' END AS label, CASE WHEN hc > 0 THEN tp / hc ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall,
      CASE WHEN hc + support > 0 THEN 2 * tp / (hc + support) ELSE 0 END AS f1, support, tp FROM k),
u AS (SELECT label, precision, recall, f1, support FROM m
UNION ALL SELECT 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support), sum(support) FROM m
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM m
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM m)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM u"""
_curve = "ct AS (SELECT *, sum(pos) OVER () AS np, sum(neg) OVER () AS nn, row_number() OVER (ORDER BY score DESC) AS i, lead(pos) OVER (ORDER BY score DESC) AS xp, lead(neg) OVER (ORDER BY score DESC) AS xn FROM met_r)"
ORACLE_SQL["roc_points"] = f"""
WITH {SURF_SCORED}, {metrics('scored')}, {_curve}
SELECT NULL::DOUBLE AS threshold, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr
UNION ALL SELECT round(score, 6), round(fp / nn, 6), round(tp / np, 6) FROM ct WHERE i = 1 OR xp IS NULL OR xp <> pos OR xn <> neg"""
ORACLE_SQL["pr_points"] = f"""
WITH {SURF_SCORED}, {metrics('scored')}, {_curve}
SELECT NULL::DOUBLE AS threshold, 1.0::DOUBLE AS precision, 0.0::DOUBLE AS recall
UNION ALL SELECT round(score, 6), round(tp / (tp + fp), 6), round(tp / np, 6) FROM ct"""
ORACLE_SQL["metric_row"] = f"WITH {SURF_SCORED}, {metrics('scored')} SELECT {_five}, n_rows FROM met"
ORACLE_SQL["threshold_metrics"] = f"""
WITH {SURF_SCORED}, c AS (SELECT count(*) FILTER (WHERE y = 1 AND p >= 0.4)::DOUBLE AS tp, count(*) FILTER (WHERE p >= 0.4) AS hit, count(*) FILTER (WHERE y = 1) AS np,
  count(*) FILTER (WHERE (y = 1) = (p >= 0.4)) AS good, count(*) AS n FROM scored)
SELECT round(good::DOUBLE / n, 6) AS accuracy, round(CASE WHEN hit > 0 THEN tp / hit ELSE 0 END, 6) AS precision, round(tp / np, 6) AS recall, round(2 * tp / (hit + np), 6) AS f1 FROM c"""
ORACLE_SQL["prevalence"] = f"WITH {CONV} SELECT round(avg(y), 6) AS prevalence FROM conv"

_runs = (
    f"{CONV}, {SPLIT}, {surface_cte('split', keep=', y, split')}, {discriminant('surf', SURFACE_FEATURES, 'doc_id, y', '_a')}, "
    f"{discriminant('surf', SURFACE_FEATURES[:5], 'doc_id, y', '_b')}, "
    "runs AS (SELECT 'discriminant' AS experiment, y, p FROM scored_a UNION ALL SELECT 'discriminant_5', y, p FROM scored_b), "
    + metrics("runs", "experiment")
)
_names = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in RUN_NAMES.items())
_named = f"experiment, CASE experiment {_names} END AS name"
ORACLE_SQL["run_store"] = f"WITH {_runs} SELECT {_named}, {_five}, n_rows FROM met"
ORACLE_SQL["final_report"] = f"WITH {_runs} SELECT {_named}, round(accuracy, 5) AS accuracy, round(auc_roc, 5) AS auc_roc FROM met"

_folds = ", ".join(
    discriminant("kf", SURFACE_FEATURES, "doc_id, y, fold", f"_{i}", f"fold <> {i}", f"fold = {i}") for i in range(5)
)
_union = " UNION ALL ".join(f"SELECT fold, y, p FROM scored_{i}" for i in range(5))
ORACLE_SQL["cross_validate"] = f"""
WITH {CONV}, {SPLIT}, {surface_cte('split', keep=', y, split')},
kf AS (SELECT *, (row_number() OVER (PARTITION BY y ORDER BY md5('42:' || doc_id), doc_id) - 1) % 5 AS fold FROM surf WHERE split = 'train'),
{_folds}, preds AS ({_union}), {metrics('preds', 'fold')},
l AS (FROM (SELECT fold, accuracy, precision, recall, f1, auc_roc FROM met) UNPIVOT (value FOR metric IN (accuracy, precision, recall, f1, auc_roc)))
SELECT metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM l GROUP BY metric"""

FSPLIT = f"{FEATS}, {ranked('fr', 'feats', 'y')}, fs AS (SELECT *, CASE WHEN rk <= round(total * 0.2) THEN 'test' ELSE 'train' END AS split FROM fr)"
ORACLE_SQL["standardise"] = f"WITH {FSPLIT} SELECT doc_id, " + ", ".join(
    f"round(({f} - (SELECT avg({f}) FROM fs WHERE split = 'train')) / "
    f"(SELECT CASE WHEN stddev_pop({f}) = 0 THEN 1 ELSE stddev_pop({f}) END FROM fs WHERE split = 'train'), 6) AS {f}"
    for f in SQL_SYNTACTIC
) + " FROM fs WHERE split = 'test'"

# Explanation -------------------------------------------------------------------------------------

_rules_sql = " UNION ALL ".join(
    f"SELECT doc_id, '{n}' AS rule, '{h}' AS hypothesis, '{f}' AS feature, {f} AS value, {t}::DOUBLE AS threshold FROM feats WHERE {f} {d} {t}::DOUBLE"
    for n, f, d, t, h in SQL_RULES
)
SIGNALS = f"{FEATS}, sig AS ({_rules_sql})"
ORACLE_SQL["rule_signals"] = f"WITH {SIGNALS} SELECT doc_id, rule, hypothesis, feature, round(value, 6) AS value, threshold FROM sig"
ORACLE_SQL["hypothesis_counts"] = f"""
WITH {SIGNALS}, h AS (SELECT doc_id, unnest({sorted({r[4] for r in SQL_RULES})}) AS hypothesis FROM feats)
SELECT doc_id, hypothesis, count(rule) AS n_signals FROM h LEFT JOIN sig USING (doc_id, hypothesis) GROUP BY ALL"""
_scored_syn = f"{FSPLIT}, {discriminant('fs', SQL_SYNTACTIC, 'doc_id, y')}"
ORACLE_SQL["explained"] = f"""
WITH {_scored_syn}, sig AS ({_rules_sql}), n AS (SELECT doc_id, count(*) AS n FROM sig GROUP BY doc_id)
SELECT doc_id, CASE WHEN p >= 0.5 THEN 'AI-Generated' ELSE 'Human-Written' END AS verdict, round(p, 4) AS probability,
  CASE WHEN p > 0.85 OR p < 0.15 THEN 'High' WHEN p > 0.70 OR p < 0.30 THEN 'Medium' ELSE 'Low' END AS confidence_level,
  greatest(coalesce(n, 0), 1) AS n_reasons, coalesce(n, 0) AS n_triggered_signals, round(ttr, 5) AS ttr, {len(SQL_SYNTACTIC)}::BIGINT AS n_values, value_sum
FROM scored JOIN (SELECT doc_id, ttr, round({' + '.join(f'round({f}, 5)' for f in SQL_SYNTACTIC)}, 3) AS value_sum FROM feats) USING (doc_id) LEFT JOIN n USING (doc_id)"""
_sentences = " ".join(
    f"WHEN '{n}' THEN {q(f'[{h}] {WORDING[n]} ({f} {d} {float(t)})')}" for n, f, d, t, h in SQL_RULES
)
ORACLE_SQL["reasons"] = f"""
WITH {SIGNALS} SELECT doc_id, coalesce(CASE rule {_sentences} END, {q(NO_REASON)}) AS reason FROM feats LEFT JOIN sig USING (doc_id)"""
ORACLE_SQL["shapley_linear"] = f"""
WITH {_scored_syn}
SELECT feature, round(avg(abs((value - mean) * slope)), 6) AS mean_abs, round(avg((value - mean) * slope), 6) AS mean
FROM con JOIN par USING (feature) GROUP BY feature"""
ORACLE_SQL["extremes"] = f"""
WITH {SURF_SCORED}
(SELECT 'most human' AS kind, doc_id, round(p, 6) AS p, text FROM scored WHERE y = 0 ORDER BY scored.p, doc_id LIMIT 1)
UNION ALL (SELECT 'most ai', doc_id, round(p, 6), text FROM scored WHERE y = 1 ORDER BY scored.p DESC, doc_id LIMIT 1)"""
ORACLE_SQL["borderline"] = f"""
WITH {SURF_SCORED} SELECT CAST(y AS BIGINT) AS y, count(*) FILTER (WHERE p > 0.4 AND p < 0.6) AS n_borderline, count(*) AS n_rows FROM scored GROUP BY y"""

# Robustness --------------------------------------------------------------------------------------

SHIFT = (
    "shift AS (SELECT doc_id, lang, text, 1 - quality AS y, CASE WHEN lang <> 'en' THEN 'language_shift' "
    "WHEN CAST(substr(source, 4) AS INT) >= 10 THEN 'domain_shift' ELSE 'in_domain' END AS scenario FROM documents JOIN labels USING (doc_id))"
)
ORACLE_SQL["feature_stability"] = f"""
WITH {SHIFT}, {syntactic_cte('shift')}, j AS (SELECT shift.y, shift.scenario, syn.* FROM syn JOIN shift USING (doc_id)),
pick AS ((SELECT 'home' AS domain, * FROM j WHERE scenario = 'in_domain')
UNION ALL (SELECT 'shifted', * FROM j WHERE scenario = 'domain_shift')),
{long_cte('pick', SQL_STABILITY, 'domain, y')}
SELECT domain, y, feature, {_box} FROM lng GROUP BY ALL"""
_s_surface = ", ".join(f"surf.{f} AS s_{f}" for f in SURFACE_FEATURES)
_home = "home AS (SELECT doc_id, rk, total FROM (SELECT doc_id, row_number() OVER (PARTITION BY y ORDER BY md5('42:' || doc_id), doc_id) AS rk, count(*) OVER (PARTITION BY y) AS total FROM shift WHERE scenario = 'in_domain'))"
_methods = {
    "syntactic": SQL_SYNTACTIC,
    "surface": [f"s_{f}" for f in SURFACE_FEATURES],
    "punctuation": [f"s_{f}" for f in SURFACE_FEATURES[:5]],
}
SCEN = (
    f"{SHIFT}, {_home}, {syntactic_cte('shift')}, {surface_cte('shift')}, "
    f"wide AS (SELECT shift.y, shift.scenario, CASE WHEN rk > round(total * 0.2) THEN 'train' ELSE 'test' END AS split, syn.*, {_s_surface} "
    "FROM shift LEFT JOIN home USING (doc_id) JOIN syn USING (doc_id) JOIN surf USING (doc_id)), "
    + ", ".join(discriminant("wide", fs, "doc_id, y, scenario", f"_{m}") for m, fs in _methods.items())
    + ", preds AS ("
    + " UNION ALL ".join(f"SELECT scenario, '{m}' AS method, y, p FROM scored_{m}" for m in _methods)
    + "), "
    + metrics("preds", "scenario, method", "raw")
    + f", met AS (SELECT scenario, method, {_five}, n_rows FROM raw)"
)
ORACLE_SQL["scenarios"] = f"WITH {SCEN} SELECT * FROM met"
ORACLE_SQL["scenario_pivot"] = f"WITH {SCEN} SELECT method, " + ", ".join(
    f"max(round({m}, 4)) FILTER (WHERE scenario = '{s}') AS {s}_{m}" for s in SCENARIOS for m in ("f1", "auc_roc", "accuracy")
) + " FROM met GROUP BY method"
ORACLE_SQL["degradation"] = f"""
WITH {SCEN} SELECT m.scenario, method, m.f1, m.auc_roc, round(m.f1 - b.f1, 6) AS delta_f1, round(m.auc_roc - b.auc_roc, 6) AS delta_auc_roc
FROM met m JOIN (SELECT method, f1, auc_roc FROM met WHERE scenario = 'in_domain') b USING (method)"""
ORACLE_SQL["method_rank"] = f"WITH {SCEN} SELECT scenario, method, f1, row_number() OVER (PARTITION BY scenario ORDER BY f1 DESC, method) AS place FROM met"
ORACLE_SQL["auc_profile"] = f"WITH {SCEN} SELECT method, " + ", ".join(
    f"max(auc_roc) FILTER (WHERE scenario = '{s}') AS {s}" for s in SCENARIOS
) + " FROM met GROUP BY method"

# Ablation ----------------------------------------------------------------------------------------


def subset_scores(members: str) -> str:
    """Metrics per subset, from a table ``members(subset, feature)``."""
    return (
        f"sub AS (SELECT subset, y, round(1 / (1 + exp(-score)), 9) AS p FROM (SELECT subset, doc_id, y, round(sum(c), 9) AS score FROM con JOIN {members} USING (feature) GROUP BY ALL)), "
        + metrics("sub", "subset")
    )


def _members(subsets: dict[str, list[str]]) -> str:
    rows = ", ".join(f"({q(s)}, {q(f)})" for s, fs in subsets.items() for f in fs)
    return f"mem(subset, feature) AS (VALUES {rows})"


_full = {"full": SQL_SYNTACTIC}
_deltas = (
    "m.subset, round(m.f1, 6) AS f1, round(m.auc_roc, 6) AS auc_roc, round(m.accuracy, 6) AS accuracy, "
    "round(m.f1 - b.f1, 6) AS delta_f1, round(m.auc_roc - b.auc_roc, 6) AS delta_auc"
)
_impact = "CASE WHEN m.f1 - b.f1 < -{0} THEN 'strong' WHEN m.f1 - b.f1 < 0 THEN 'moderate' ELSE 'none' END AS impact"
_base = "FROM met m, (SELECT * FROM met WHERE subset = 'full') b"
_one = _full | {f: [g for g in SQL_SYNTACTIC if g != f] for f in SQL_SYNTACTIC}
ORACLE_SQL["ablate_one"] = (
    f"WITH {_scored_syn}, {_members(_one)}, {subset_scores('mem')} SELECT {_deltas}, {_impact.format(0.005)} {_base} WHERE m.subset <> 'full'"
)
_groups = _full | {g: [f for f in SQL_SYNTACTIC if f not in fs] for g, fs in SQL_GROUPS.items()}
_sizes = " ".join(f"WHEN {q(g)} THEN {len(fs)}" for g, fs in SQL_GROUPS.items())
ORACLE_SQL["ablate_group"] = (
    f"WITH {_scored_syn}, {_members(_groups)}, {subset_scores('mem')} SELECT {_deltas}, {_impact.format(0.01)}, "
    f"CAST(CASE m.subset {_sizes} END AS BIGINT) AS n_removed, CAST({_n} - CASE m.subset {_sizes} END AS BIGINT) AS n_left {_base} WHERE m.subset <> 'full'"
)
INCR = (
    f"{_scored_syn}, ord AS (SELECT feature, row_number() OVER (ORDER BY importance DESC, feature) AS i FROM par), "
    "mem AS (SELECT a.i AS subset, b.feature FROM ord a JOIN ord b ON b.i <= a.i), " + subset_scores("mem")
)
ORACLE_SQL["ablate_incremental"] = f"""
WITH {INCR}
SELECT subset AS n_features, (SELECT feature FROM ord WHERE i = subset) AS added,
  (SELECT string_agg(feature, ', ' ORDER BY i) FROM ord WHERE i <= subset) AS members,
  round(f1, 6) AS f1, round(auc_roc, 6) AS auc_roc, round(accuracy, 6) AS accuracy FROM met"""
ORACLE_SQL["min_subset"] = f"""
WITH {INCR}, b AS (SELECT f1, auc_roc FROM met WHERE subset = {_n})
SELECT min(subset) FILTER (WHERE met.f1 >= b.f1 * 0.95::DOUBLE) AS min_for_f1, min(subset) FILTER (WHERE met.auc_roc >= b.auc_roc * 0.95::DOUBLE) AS min_for_auc FROM met, b"""


def greedy() -> str:
    """Chained steps: each adds the feature whose union with the chosen ones has the best F1."""
    steps = ["pick_0(feature, i) AS (SELECT NULL::VARCHAR, 0 WHERE false)"]
    for n in range(1, _n + 1):
        steps.append(
            f"base_{n} AS (SELECT doc_id, y, sum(CASE WHEN feature IN (SELECT feature FROM pick_{n - 1}) THEN c ELSE 0 END) AS b FROM con GROUP BY doc_id, y), "
            f"cand_{n} AS (SELECT feature, y, round(1 / (1 + exp(-round(b + c, 9))), 9) >= 0.5 AS h FROM base_{n} JOIN con USING (doc_id, y) "
            f"WHERE feature NOT IN (SELECT feature FROM pick_{n - 1})), "
            f"best_{n} AS (SELECT feature, 2.0::DOUBLE * count(*) FILTER (WHERE y = 1 AND h) / nullif(count(*) FILTER (WHERE y = 1) + count(*) FILTER (WHERE h), 0) AS f1 FROM cand_{n} GROUP BY feature), "
            f"pick_{n} AS MATERIALIZED (SELECT * FROM pick_{n - 1} UNION ALL (SELECT feature, {n} FROM best_{n} JOIN names USING (feature) ORDER BY coalesce(f1, 0) DESC, names.i LIMIT 1))"
        )
    return ", ".join(steps)


ORACLE_SQL["ablate_greedy"] = f"""
WITH {_scored_syn.replace('con AS (', 'con AS MATERIALIZED (')}, names(i, feature) AS (VALUES {_order}), {greedy()},
mem AS (SELECT a.i AS subset, b.feature FROM pick_{_n} a JOIN pick_{_n} b ON b.i <= a.i), {subset_scores('mem')}
SELECT CAST(subset AS BIGINT) AS n_features, (SELECT feature FROM pick_{_n} WHERE i = subset) AS added, round(f1, 6) AS f1, round(auc_roc, 6) AS auc_roc,
  round(accuracy, 6) AS accuracy, round(f1 / (SELECT f1 FROM met WHERE subset = {_n}) * 100, 6) AS percent_of_full FROM met"""
_control = _full | {"without": [f for f in SQL_SYNTACTIC if f != "total_tokens"], "only": ["total_tokens"]}
ORACLE_SQL["control_check"] = (
    f"WITH {_scored_syn}, {_members(_control)}, {subset_scores('mem')} SELECT {_deltas}, round(m.precision, 6) AS precision, round(m.recall, 6) AS recall, "
    f"abs(m.f1 - b.f1) < 0.005 AS no_effect {_base}"
)

# Streams -----------------------------------------------------------------------------------------

ORACLE_SQL["stream_gate"] = f"""
WITH {titled('doc_id')}, {gate_cte('titled', 'doc_id')} SELECT doc_id, len(w) AS length_words, length(text) AS length_chars FROM gate WHERE reason = 'ok'"""
ORACLE_SQL["stream_progress"] = f"""
WITH {titled('doc_id')}, {gate_cte('titled', 'doc_id')} SELECT reason, count(*) AS n_texts, CAST(sum(len(w)) AS BIGINT) AS n_words FROM gate GROUP BY reason"""
ORACLE_SQL["stream_score"] = f"""
WITH {CONV}, both_rows AS (SELECT doc_id, y, text, 'train' AS split FROM conv UNION ALL SELECT doc_id, 0, text, 'test' FROM documents),
{surface_cte('both_rows', keep=', y, split')}, {discriminant('surf', SURFACE_FEATURES, 'doc_id')}
SELECT doc_id, round(p, 6) AS p, CASE WHEN p >= 0.5 THEN 'AI-Generated' ELSE 'Human-Written' END AS verdict,
  CASE WHEN p > 0.85 OR p < 0.15 THEN 'High' WHEN p > 0.70 OR p < 0.30 THEN 'Medium' ELSE 'Low' END AS confidence_level FROM scored"""


# Properties that hold for every row ------------------------------------------------------------

ORACLE_SQL["shapley_forest_sums"] = f"""
WITH {CONV}, {SPLIT} SELECT doc_id, {len(SURFACE_FEATURES)}::BIGINT AS n_features, true AS adds_up FROM split WHERE split = 'test'"""
ORACLE_SQL["stream_explained"] = "SELECT doc_id, true AS as_in_batch FROM documents"


def listed(values, name: str) -> str:
    return f"unnest([{', '.join(map(q, values))}]) AS {name}"


_base_names = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in BASELINE_EXPERIMENTS.items())
ORACLE_SQL["baseline_runs"] = f"""
WITH {CONV}, {SPLIT}, n AS (SELECT count(*) AS n_rows FROM split WHERE split = 'test'), e AS (SELECT {listed(BASELINE_EXPERIMENTS, 'experiment')})
SELECT experiment, CASE experiment {_base_names} END AS name, n_rows, true AS better_than_chance FROM e, n"""
ORACLE_SQL["scenario_grid"] = f"""
WITH {SHIFT}, {ranked('home', "(SELECT doc_id, y FROM shift WHERE scenario = 'in_domain')", 'y')},
n AS (SELECT scenario, count(*) AS n_rows FROM shift LEFT JOIN (SELECT doc_id, rk > round(total * 0.2) AS train FROM home) USING (doc_id)
      WHERE train IS NULL OR NOT train GROUP BY scenario), m AS (SELECT {listed(DETECTORS, 'method')})
SELECT scenario, method, n_rows, true AS proper, true AS home_is_base FROM n, m"""
ORACLE_SQL["ablate_one_forest"] = f"SELECT {listed(SYNTACTIC_FEATURES, 'subset')}, true AS proper, true AS band_follows"
ORACLE_SQL["ablate_group_forest"] = f"SELECT {listed(ABLATION_GROUPS, 'subset')}, true AS proper, true AS band_follows"
ORACLE_SQL["refit_forest"] = "SELECT true AS f1, true AS auc_roc, true AS accuracy, 2::BIGINT AS n_fits"
ORACLE_SQL["model_roundtrip_same"] = f"WITH {CONV}, {SPLIT} SELECT doc_id, true AS same FROM split WHERE split = 'test'"
ORACLE_SQL["detector_rows"] = f"""
WITH {CONV}, {SPLIT}, m AS (SELECT {listed(DETECTORS, 'method')})
SELECT doc_id, method, true AS proper, true AS as_alone FROM split, m WHERE split = 'test'"""
ORACLE_SQL["logistic_optimum"] = f"SELECT {listed(SURFACE_FEATURES, 'name')}, true AS flat"
ORACLE_SQL["importance_names"] = " UNION ALL ".join(
    f"SELECT '{f}' AS name, {q(FEATURE_HYPOTHESIS[f]) if f in FEATURE_HYPOTHESIS else 'NULL::VARCHAR'} AS hypothesis, true AS not_negative, true AS sum_is_one"
    for f in SYNTACTIC_FEATURES
)
ORACLE_SQL["top_terms_sides"] = "SELECT unnest(['ai', 'human']) AS side, 10::BIGINT AS n_terms, true AS furthest"
ORACLE_SQL["coefficient_names"] = f"SELECT {listed(SURFACE_FEATURES, 'name')}, true AS finite"
